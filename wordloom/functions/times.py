"""Times as text, and small numeric rules. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clock(ms: Column, pad_hour: bool, unit: int, width: int) -> Column:
    ms = F.greatest(ms.cast("bigint"), F.lit(0))

    def div(n: int) -> Column:
        return F.floor(ms / F.lit(n)).cast("bigint")

    hours = div(3_600_000).cast("string")
    hours = F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours) if pad_hour else hours
    return F.concat(
        hours, F.lit(":"), F.lpad((div(60_000) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((div(1000) % 60).cast("string"), 2, "0"),
        F.lit("."), F.lpad((F.floor(ms % 1000 / unit).cast("bigint")).cast("string"), width, "0"),
    )


def vtt_time(ms: Column) -> Column:
    """HH:MM:SS.mmm of milliseconds, not below 0 (M1)."""
    return _clock(ms, True, 1, 3)


def ass_time(ms: Column) -> Column:
    """H:MM:SS.cc of milliseconds, centiseconds cut off, not rounded (M2)."""
    return _clock(ms, False, 10, 2)


def milliseconds(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("bigint")


def clamp(x: Column, duration: Column) -> Column:
    """Into [0, duration] (M3)."""
    return F.greatest(F.lit(0), F.least(x, duration))


def finite(x: Column) -> Column:
    """The number, or null for what isn't a finite number (M4)."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def item_bounds(start: Column, end: Column) -> tuple[Column, Column]:
    """Both bounds in order; null if either isn't finite (M5)."""
    a, b = finite(start), finite(end)
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.least(a, b)), F.when(both, F.greatest(a, b))


def frames_per_second(rate: Column) -> Column:
    """Of "num/den"; 0 if den is 0 or it can't be read (M6)."""
    parts = F.split(rate, "/")
    num = F.try_element_at(parts, F.lit(1)).try_cast("double")
    den = F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("double"), F.when(F.size(parts) == 1, F.lit(1.0)))
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def duration_tolerance(duration: Column) -> Column:
    """0.2 % of the duration, within [0.25, 2] seconds (M7)."""
    return F.greatest(F.lit(0.25), F.least(F.lit(2.0), duration * F.lit(0.002)))


def linear_bounds(position: Column, total: Column, duration: Column) -> tuple[Column, Column]:
    """Even share of a stretch for the item at a position."""
    each = duration / F.greatest(total, F.lit(1))
    return position * each, (position + 1) * each


def seconds_per_word(duration: Column, words: Column) -> Column:
    """(M11)"""
    return duration / F.greatest(words, F.lit(1))


def font_cap(width: Column) -> Column:
    """Largest font of a subtitle: 52 on narrow pictures (up to 820), else 4.6 % of the width within [56, 76] (M9)."""
    return F.when(width <= 820, F.lit(52.0)).otherwise(F.least(F.lit(76.0), F.greatest(F.lit(56.0), width * F.lit(0.046))))


def frame_bounds(start: Column, end: Column, rate: int, frames: Column) -> tuple[Column, Column]:
    """First frame and frame count of a window of audio."""
    first = F.least(F.greatest(F.round(start * rate).cast("bigint"), F.lit(0)), frames)
    last = F.least(F.greatest(F.round(end * rate).cast("bigint"), first), frames)
    return first, last - first
