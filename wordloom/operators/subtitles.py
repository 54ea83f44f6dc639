"""Subtitle rows: WebVTT cues and the events of a karaoke-style ASS track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import ass_escape
from wordloom.functions.times import ass_time, vtt_time

# The track's header and styles, as players need them.
ASS_HEADER = """[Script Info]
ScriptType: v4.00+
Collisions: Normal
PlayResX: {width}
PlayResY: {height}
Timer: 100.0000
WrapStyle: 0
ScaledBorderAndShadow: yes

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Default,Geist,76,&HF6F2E9,&HF6F2E9,&H55000000,&HFF000000,-1,0,0,0,100,100,0,0,1,2,2,5,0,0,0,1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""
IDLE_STYLE = r"\1c&HF6F2E9&\3c&H55000000&\bord2\shad2"
ACTIVE_STYLE = r"\1c&H170725&\3c&H67C8FF&\bord1\shad0"
GLOW_STYLE = r"\p1\pos(0,0)\an7\1c&H67C8FF&\alpha&H82&\blur8\bord0\shad0"
BOX_STYLE = r"\p1\pos(0,0)\an7\1c&H67C8FF&\3c&H4397C9&\bord3\shad0"


def vtt_cues(spans: DataFrame) -> DataFrame:
    """(doc_id, index, cue) of spans (doc_id, index from 0, text, start, end in ms): cues numbered from 1 (K3)."""
    cue = F.concat((F.col("index") + 1).cast("string"), F.lit("\n"), vtt_time(F.col("start")), F.lit(" --> "), vtt_time(F.col("end")), F.lit("\n"), "text", F.lit("\n"))
    return spans.select("doc_id", "index", cue.alias("cue"))


def vtt_documents(spans: DataFrame) -> DataFrame:
    """(doc_id, vtt): a whole file each."""
    ordered = F.array_sort(F.collect_list(F.struct("index", "cue")))
    return vtt_cues(spans).groupBy("doc_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(ordered, lambda c: c["cue"]), "\n")).alias("vtt"))


def rounded_box(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Drawing of a rectangle with round corners, clockwise from the upper left (M8)."""
    r = F.least(F.lit(28.0), height * 0.26, width * 0.18)
    right, bottom = x + width, y + height

    def points(*at: tuple[Column, Column]) -> Column:
        return F.format_string(" ".join(["%.2f %.2f"] * len(at)), *[c.cast("double") for p in at for c in p])

    sides = ((x + r, y), (right - r, y)), ((right, y), (right, y + r)), ((right, bottom - r),), ((right, bottom), (right - r, bottom)), ((x + r, bottom),), ((x, bottom), (x, bottom - r)), ((x, y + r),), ((x, y), (x + r, y))
    (move, line), *rest = sides
    parts = [F.concat(F.lit("m "), points(move)), F.concat(F.lit("l "), points(line))]
    for side in rest:
        corner, *to = side
        # a corner is a curve whose two control points both lie in it
        parts.append(F.concat(F.lit("b "), points(corner, corner, to[0])) if to else F.concat(F.lit("l "), points(corner)))
    return F.concat_ws(" ", *parts)


def _event(layer: int, start: Column, end: Column, body: Column) -> Column:
    return F.concat(F.lit(f"Dialogue: {layer},"), ass_time(start), F.lit(","), ass_time(end), F.lit(",Default,,0,0,0,,"), body)


def ass_events(words: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, segment, sentence_index, index, nth, layer, event) (K4, J6): rows of a segment's track.

    words: (doc_id, sentence_index, index, text, s_start, s_end, focus_start, focus_end in ms, rect with x, y, width,
    height, textX, textY, textWidth, textHeight, fontSize). segments: (doc_id, segment, start, end). Sentences are cut
    to the segment and times count from its start. A word with a positive focus inside has up to five rows: idle
    before and after, a glow, a box, and the active text; any other has one idle row.
    """
    both = words.join(segments, "doc_id").filter((F.col("s_start") < F.col("end")) & (F.col("s_end") > F.col("start")))
    b0, b1 = F.greatest("s_start", "start"), F.least("s_end", "end")
    f0, f1 = F.greatest(b0, "focus_start"), F.least(b1, "focus_end")
    r = F.col("rect")
    x, y = F.coalesce(r["textX"], r["x"]) + F.coalesce(r["textWidth"], r["width"]) / 2, F.coalesce(r["textY"], r["y"]) + F.coalesce(r["textHeight"], r["height"]) / 2
    size = F.greatest(F.lit(16), F.bround(r["fontSize"]).cast("int"))
    box = rounded_box(r["x"], r["y"], r["width"], r["height"])

    def spoken(layer: int, start: Column, end: Column, style: str) -> Column:
        head = F.format_string(r"{\fnGeist\b1\an5\pos(%.2f,%.2f)\fs%d" + style + "}", x.cast("double"), y.cast("double"), size)
        return F.struct(F.lit(layer).alias("layer"), _event(layer, start - F.col("start"), end - F.col("start"), F.concat(head, ass_escape(F.col("text")))).alias("event"))

    def drawn(layer: int, style: str) -> Column:
        body = F.concat(F.lit("{" + style + "}"), box, F.lit(r"{\p0}"))
        return F.struct(F.lit(layer).alias("layer"), _event(layer, f0 - F.col("start"), f1 - F.col("start"), body).alias("event"))

    active = f1 > f0
    rows = F.array_compact(F.array(
        F.when(~active, spoken(0, b0, b1, IDLE_STYLE)), F.when(active & (f0 > b0), spoken(0, b0, f0, IDLE_STYLE)), F.when(active & (b1 > f1), spoken(0, f1, b1, IDLE_STYLE)),
        F.when(active, drawn(1, GLOW_STYLE)), F.when(active, drawn(2, BOX_STYLE)), F.when(active, spoken(3, f0, f1, ACTIVE_STYLE)),
    ))
    return both.select("doc_id", "segment", "sentence_index", "index", F.posexplode(rows).alias("nth", "r")).select("doc_id", "segment", "sentence_index", "index", "nth", "r.layer", "r.event")


def ass_documents(events: DataFrame, width: int, height: int) -> DataFrame:
    """(doc_id, segment, ass): a whole file each, with a byte order mark."""
    ordered = F.array_sort(F.collect_list(F.struct("sentence_index", "index", "nth", "event")))
    text = F.concat(F.lit("﻿" + ASS_HEADER.format(width=width, height=height)), F.array_join(F.transform(ordered, lambda e: e["event"]), "\n"), F.lit("\n"))
    return events.groupBy("doc_id", "segment").agg(text.alias("ass"))


def utterances(sentences: DataFrame, docs: DataFrame, margin: float = 0.35) -> DataFrame:
    """(doc_id, utterance_id, sentence_index, offset, duration): the stretch of audio to cut for each sentence."""
    s = sentences.join(docs.select("doc_id", F.col("duration").alias("_d")), "doc_id")
    start, end = F.greatest(F.lit(0.0), F.col("start") - margin), F.least("_d", F.col("end") + margin)
    return s.select("doc_id", F.format_string("utt_%05d", "sentence_index").alias("utterance_id"), "sentence_index", F.round(start, 6).alias("offset"), F.round(end - start, 6).alias("duration"))
