"""Anchors: known times of some words, matched from other word streams, and what follows from them for the rest."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from wordloom.functions import text as T

LEAST = 0.005


def in_order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("index")


def fresh(df: DataFrame, *columns: str) -> DataFrame:
    """The columns under the same names but as new ones, so that both sides of a cogroup may come from one table."""
    return df.select(*[F.col(c).alias(c) for c in columns])


def fuzzy_align(left: DataFrame, right: DataFrame, autojunk: bool = False) -> DataFrame:
    """(doc_id, left_index, right_index): order-preserving matches of two token streams (doc_id, index, token) by
    longest common blocks (J2). Grouped by document: the search is sequential within one."""
    kind = dict(left.dtypes)["doc_id"]

    def match(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("index"), b.sort_values("index")
        blocks = difflib.SequenceMatcher(None, a["token"].tolist(), b["token"].tolist(), autojunk=autojunk).get_matching_blocks()
        pairs = [(i, j) for x, y, n in blocks for i, j in zip(range(x, x + n), range(y, y + n), strict=True)]
        ai, bi = a["index"].tolist(), b["index"].tolist()
        ids = pd.Series([key[0]] * len(pairs), dtype=object)  # ids may be texts, which pandas would hold in chunks
        return pd.DataFrame({"doc_id": ids, "left_index": [ai[i] for i, _ in pairs], "right_index": [bi[j] for _, j in pairs]}).astype({"left_index": "int64", "right_index": "int64"})

    groups = fresh(left, "doc_id", "index", "token").groupBy("doc_id").cogroup(fresh(right, "doc_id", "index", "token").groupBy("doc_id"))
    return groups.applyInPandas(match, f"doc_id {kind}, left_index bigint, right_index bigint")


def usable_observations(observed: DataFrame, longer_than: float = LEAST) -> DataFrame:
    """Finite times and more than a moment."""
    limit = F.lit(float("inf"))
    return observed.filter((F.abs("start") < limit) & (F.abs("end") < limit) & (F.col("end") - F.col("start") > longer_than))


def plausible_matches(matches: DataFrame, rough: DataFrame, coarse: DataFrame, padding: float = 4.0) -> DataFrame:
    """matches (doc_id, index, rough_index) with `plausible`: is the rough word's middle within the padded coarse bounds
    of the word, if it has any (P3)?"""
    r = rough.select("doc_id", F.col("index").alias("rough_index"), ((F.col("start") + F.col("end")) / 2).alias("_mid"))
    c = coarse.select("doc_id", "index", F.col("start").alias("_cs"), F.col("end").alias("_ce"))
    both = matches.join(r, ["doc_id", "rough_index"]).join(c, ["doc_id", "index"], "left")
    inside = F.col("_mid").between(F.col("_cs") - padding, F.col("_ce") + padding)
    return both.withColumn("plausible", F.coalesce(inside, F.lit(True))).drop("_mid", "_cs", "_ce")


def anchor_precedence(coarse: DataFrame, rough: DataFrame) -> DataFrame:
    """(doc_id, index, start, end, origin): coarse bounds where there are any, rough ones elsewhere."""
    c = coarse.select("doc_id", "index", F.struct("start", "end", F.lit("coarse").alias("origin")).alias("c"))
    r = rough.select("doc_id", "index", F.struct("start", "end", F.lit("rough").alias("origin")).alias("r"))
    return c.join(r, ["doc_id", "index"], "full").select("doc_id", "index", F.coalesce("c", "r").alias("a")).select("doc_id", "index", "a.start", "a.end", "a.origin")


def anchor_coverage(words: DataFrame, anchors: DataFrame, least: float = 0.55) -> DataFrame:
    """(doc_id, words, anchored, coverage, enough) (P9): a document whose coverage is too low can't be aligned."""
    known = anchors.select("doc_id", "index").distinct().withColumn("_a", F.lit(1))
    per = words.join(known, ["doc_id", "index"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.count("_a").alias("anchored"))
    share = F.col("anchored") / F.greatest("words", F.lit(1))
    return per.withColumns({"coverage": share, "enough": share >= least})


def _neighbours(words: DataFrame, anchors: DataFrame) -> DataFrame:
    """Words with their own anchor and the nearest on either side (J8), as structs own, before, after."""
    a = anchors.select("doc_id", "index", F.struct(F.col("index").alias("i"), "start", "end").alias("own"))
    both = words.join(a, ["doc_id", "index"], "left")
    past, ahead = in_order().rowsBetween(Window.unboundedPreceding, -1), in_order().rowsBetween(1, Window.unboundedFollowing)
    return both.withColumns({"before": F.last("own", ignorenulls=True).over(past), "after": F.first("own", ignorenulls=True).over(ahead)})


def interpolated(words: DataFrame, anchors: DataFrame) -> DataFrame:
    """Words with start and end from anchors (W8): their own; between two, even steps; past the last or before the first,
    steps of that anchor's width. Null in documents without anchors."""
    w = _neighbours(words, anchors)
    i, b, a = F.col("index"), F.col("before"), F.col("after")
    steps = (a["i"] - b["i"]).cast("double")
    room = a["start"] - b["end"]
    mid_start = b["end"] + room * ((i - b["i"]) / steps)
    wide_b, wide_a = F.greatest(F.lit(LEAST), b["end"] - b["start"]), F.greatest(F.lit(LEAST), a["end"] - a["start"])
    late = b["end"] + (i - b["i"]) * wide_b
    early = a["start"] - (a["i"] - i) * wide_a
    none = F.lit(None).cast("double")
    start = F.when(F.col("own").isNotNull(), F.col("own.start")).when(b.isNotNull() & a.isNotNull(), mid_start).when(b.isNotNull(), late).when(a.isNotNull(), F.greatest(F.lit(0.0), early - wide_a)).otherwise(none)
    end = F.when(F.col("own").isNotNull(), F.col("own.end")).when(b.isNotNull() & a.isNotNull(), mid_start + F.greatest(F.lit(LEAST), room / steps)).when(b.isNotNull(), late + wide_b).when(a.isNotNull(), F.greatest(F.lit(LEAST), early)).otherwise(none)
    return w.withColumns({"start": start, "end": end}).drop("own", "before", "after")


def rough_fallback(words: DataFrame, anchors: DataFrame, crops: DataFrame) -> DataFrame:
    """Crop-relative times from anchors for the words of segments (G8): doc_id, segment_id, index, start, end."""
    timed = interpolated(words, anchors)
    unrolled = crops.select("doc_id", "segment_id", "crop_start", "crop_end", F.explode(F.expr("sequence(word_start, word_end - 1)")).alias("index"))
    both = unrolled.join(timed.select("doc_id", "index", "start", "end"), ["doc_id", "index"])
    long = F.greatest(F.lit(LEAST), F.col("crop_end") - F.col("crop_start"))
    start = F.least(long, F.greatest(F.lit(0.0), F.coalesce("start", "crop_start") - F.col("crop_start")))
    end = F.coalesce("end", F.col("crop_start") + long) - F.col("crop_start")
    return both.select("doc_id", "segment_id", "index", start.alias("start"), F.least(long, F.greatest(start + LEAST, end)).alias("end"))


def estimate_crops(segments: DataFrame, words: DataFrame, anchors: DataFrame, docs: DataFrame, longest: float = 55.0) -> DataFrame:
    """Segments (doc_id, segment_id, word_start, word_end) with the stretch of audio to align them in.

    Between a segment's first and last anchor, carried on at the document's mean pace to its ends; without anchors,
    from the nearest one before, or after, it. At least 4 s, padded by 1.35 s; what is longer than `longest` is cut
    around its middle. docs: (doc_id, duration). Documents need two anchors.
    """
    counts = words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    pace = docs.join(counts, "doc_id").select("doc_id", "duration", (F.col("duration") / F.greatest("n", F.lit(1))).alias("p"))
    firsts = _neighbours(words, anchors)
    owned = segments.select("doc_id", "segment_id", "word_start", "word_end", F.explode(F.expr("sequence(word_start, word_end - 1)")).alias("index"))
    owned = owned.join(firsts.select("doc_id", "index", "own", "before", "after"), ["doc_id", "index"])
    per = owned.groupBy("doc_id", "segment_id", "word_start", "word_end").agg(
        F.min("own").alias("first"), F.max("own").alias("last"), F.count("own").alias("rough_anchor_count"),
        F.min_by("before", "index").alias("before"), F.min_by("after", "index").alias("after"),
    )
    enough = anchors.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_anchors")).filter("n_anchors >= 2")
    flat = [F.col(f"{side}.{c}").cast("double").alias(f"{side}_{c}") for side in ("first", "last", "before", "after") for c in ("i", "start", "end")]
    s = per.join(pace, "doc_id").join(enough, "doc_id", "left_semi").select("doc_id", "segment_id", "word_start", "word_end", "rough_anchor_count", "p", "duration", *flat)
    schema = ", ".join(f"{c} {t}" for c, t in s.dtypes if c in ("doc_id", "segment_id", "word_start", "word_end", "rough_anchor_count"))
    # as one expression this is more than the code generator takes
    crops = s.mapInPandas(lambda batches: (_crops(pdf, longest) for pdf in batches), f"{schema}, crop_start double, crop_end double, raw_crop_span double, crop_clipped boolean")
    return crops.select("doc_id", "segment_id", "word_start", "word_end", "crop_start", "crop_end", "rough_anchor_count", "raw_crop_span", "crop_clipped").filter("crop_end > crop_start")


def _crops(s: pd.DataFrame, longest: float) -> pd.DataFrame:
    """Crops of segments with their first and last anchors, and the nearest outside, in columns."""
    p, a, b, has = s["p"], s["word_start"], s["word_end"], s["rough_anchor_count"] > 0
    mid = {side: (s[f"{side}_start"] + s[f"{side}_end"]) / 2 for side in ("first", "last", "before", "after")}
    from_before, from_after = mid["before"] + (a - s["before_i"]) * p, mid["after"] - (s["after_i"] - a) * p
    first = (mid["first"] - (s["first_i"] - a) * p).where(has, from_before.where(s["before_i"].notna(), from_after))
    last = (mid["last"] + (b - 1 - s["last_i"]) * p).where(has, first + (b - a - 1).clip(lower=0) * p)
    begin = (first - p / 2).where(~has, np.fmin(first - p / 2, s["first_start"]))
    end = (last + p / 2).where(~has, np.fmax(last + p / 2, s["last_end"]))
    wanted = np.maximum(4.0, (last - first).clip(lower=0) + np.maximum(1.0, 2 * p))
    pad = ((wanted - (end - begin)) / 2).clip(lower=0) + 1.35
    begin, end = begin - pad, end + pad
    span = end - begin
    width, center = np.minimum(longest, np.maximum(12.0, wanted + 2.7)), (first + last) / 2
    clipped = span > longest
    begin, end = begin.where(~clipped, center - width / 2), end.where(~clipped, center + width / 2)
    kept = s[["doc_id", "segment_id", "word_start", "word_end", "rough_anchor_count"]]
    return kept.assign(crop_start=begin.clip(lower=0).round(4), crop_end=np.minimum(s["duration"], end).round(4), raw_crop_span=span.round(4), crop_clipped=clipped)


def cut_segments(n: int, times: list[float | None], most: int = 60, gap: float = 8.0, span: float = 35.0) -> list[tuple[int, int]]:
    """Half-open ranges of a chunk's `n` words (G4). times: each word's anchor middle, or None.

    A range ends at `most` words, or before a word whose time, or for one without the next known time in the chunk, lies
    more than `gap` after the range's last anchor or more than `span` after its first.
    """
    following: list[float | None] = [None] * n
    seen = None
    for k in range(n - 1, -1, -1):
        seen = times[k] if times[k] is not None else seen
        following[k] = seen
    out, begin, first, last = [], 0, None, None
    for k in range(n):
        ahead = following[k]
        far = last is not None and ahead is not None and (ahead - last > gap or ahead - first > span)
        if k > begin and (k - begin >= most or far):
            out.append((begin, k))
            begin, first, last = k, None, None
        if times[k] is not None:
            first, last = times[k] if first is None else first, times[k]
    return [*out, (begin, n)] if n else out


def alignment_segments(words: DataFrame, anchors: DataFrame, most: int = 60) -> DataFrame:
    """Segments of every chunk (G4): doc_id, segment_id, source_chunk, word_start, word_end, word_count, text.

    words: (doc_id, chunk_index, index, text).
    """
    kind = dict(words.dtypes)["doc_id"]
    mids = anchors.select("doc_id", "index", ((F.col("start") + F.col("end")) / 2).alias("mid"))

    def cut(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index")
        index, texts = pdf["index"].tolist(), pdf["text"].tolist()
        ranges = cut_segments(len(pdf), [None if pd.isna(t) else float(t) for t in pdf["mid"]], most)
        return pd.DataFrame(
            [(key[0], f"c{key[1]:03d}-{k:03d}", key[1], index[a], index[b - 1] + 1, b - a, " ".join(texts[a:b])) for k, (a, b) in enumerate(ranges)],
            columns=["doc_id", "segment_id", "source_chunk", "word_start", "word_end", "word_count", "text"],
        )

    timed = words.select("doc_id", "chunk_index", "index", "text").join(mids, ["doc_id", "index"], "left")
    return timed.groupBy("doc_id", "chunk_index").applyInPandas(cut, f"doc_id {kind}, segment_id string, source_chunk bigint, word_start bigint, word_end bigint, word_count bigint, text string")


def spread_windows(windows: list[tuple[int, float, float, list[str], list[str]]], most: int = 48) -> list[tuple[str, float, float, int]]:
    """(word, start, end, window) of windows (number, start, end, words, join keys) in order.

    A window adds the words that don't repeat the end of what there is, evenly over what it has left after the last one.
    """
    out, keys, last = [], [], 0.0
    for number, start, end, words, own in windows:
        known = next((k for k in range(min(most, len(keys), len(own)), 1, -1) if keys[-k:] == own[:k]), 0)
        begin, new = max(start, last), words[known:]
        length = max(0.01, max(begin + 0.01, start, end) - begin)
        for k, word in enumerate(new):
            at = begin + length * k / len(new)
            out.append((word, at, max(at + LEAST, begin + length * (k + 1) / len(new)), number))
        keys += own[known:]
        last = out[-1][2] if new else last
    return out


def window_word_times(windows: DataFrame, order: str = "window_index") -> DataFrame:
    """(doc_id, pos, text, start, end, window_index): spread_windows over (doc_id, order, text, start, end). Each window's
    start depends on what came before, so a document goes to one Python group."""
    kind = dict(windows.dtypes)["doc_id"]
    words = T.tokens(F.col("text"))
    keyed = windows.filter(F.size(words) > 0).select("doc_id", F.col(order).cast("bigint").alias("o"), F.col("start").cast("double").alias("s"), F.col("end").cast("double").alias("e"), words.alias("words"), T.stitch_keys(F.col("text")).alias("keys"))

    def spread(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        rows = spread_windows([(o, s, e, list(w), list(k)) for o, s, e, w, k in zip(pdf["o"], pdf["s"], pdf["e"], pdf["words"], pdf["keys"], strict=True)])
        return pd.DataFrame([(key[0], pos, *row) for pos, row in enumerate(rows)], columns=["doc_id", "pos", "text", "start", "end", "window_index"])

    return keyed.groupBy("doc_id").applyInPandas(spread, f"doc_id {kind}, pos bigint, text string, start double, end double, window_index bigint")


def character_bounds(observed: DataFrame) -> DataFrame:
    """(doc_id, index, offset, character, start, end): a word's span shared evenly by its characters."""
    chars = observed.filter("token <> ''").select("doc_id", "index", "start", "end", F.length("token").alias("n"), F.posexplode(F.filter(F.split("token", ""), lambda c: c != "")).alias("offset", "character"))
    long = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    return chars.select("doc_id", "index", "offset", "character", (F.col("start") + long * F.col("offset") / F.col("n")).alias("start"), (F.col("start") + long * (F.col("offset") + 1) / F.col("n")).alias("end"))


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of difflib's blocks, without junk, in order: the longest common stretch, the first
    in `a` and then in `b` of equals, and so on left and right of it. A stretch is looked up as a whole."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        at = long = 0
        i = a0
        while i + long < a1 and long < b1 - b0:
            while i + long < a1 and b.find(a[i : i + long + 1], b0, b1) >= 0:
                at, long = i, long + 1
            i += 1
        if long:
            there = b.find(a[at : at + long], b0, b1)
            out.append((at, there, long))
            todo += [(a0, at, b0, there), (at + long, a1, there + long, b1)]
    return sorted(out)


def words_from_characters(expected: list[str], observed: list[tuple[str, float, float]], duration: float) -> tuple[list[tuple[float, float]], str] | None:
    """Bounds of each expected word from timed pieces of text (W16), and whether all characters agreed.

    Characters are matched in order; a word spans its matched ones; one without any lies between the matched
    neighbours, or at its even share of the duration. None if nothing matches.
    """
    spread = [(text, a + max(0.0, b - a) * k / len(text), a + max(0.0, b - a) * (k + 1) / len(text)) for text, a, b in observed if text for k in range(len(text))]
    want, have = "".join(expected), "".join(text for text, _, _ in observed if text)
    if not want or not have:
        return None
    blocks = [(0, 0, len(want))] if want == have else matching_blocks(want, have)
    times = {i + k: spread[j + k][1:] for i, j, n in blocks for k in range(n)}
    if not times:
        return None
    known = sorted(times)
    before, after = [None] * (len(want) + 1), [None] * (len(want) + 1)  # nearest known position left of, and from, each place
    for k in range(len(want)):
        before[k + 1] = k if k in times else before[k]
    for k in range(len(want) - 1, -1, -1):
        after[k] = k if k in times else after[k + 1]
    out, at = [], 0
    for word in expected:
        own = [times[k] for k in range(at, at + len(word)) if k in times]
        left, right = before[at], after[at + len(word)]
        if own:
            start, end = min(s for s, _ in own), max(e for _, e in own)
        elif left is not None and right is not None:
            start = min(times[left][1], times[right][0])
            end = max(start + LEAST, times[right][0])
        else:
            start = duration * at / len(want)
            end = max(start + LEAST, duration * (at + 1) / len(want))
        out.append((max(0.0, start), min(duration, max(start + LEAST, end))))
        at += len(word)
    return out, "char_exact" if len(known) == len(want) and want == have else "char_partial"


PLACED = StructType([StructField("start", ArrayType(DoubleType())), StructField("end", ArrayType(DoubleType())), StructField("mode", StringType())])


@F.pandas_udf(PLACED)
def _placed(words: pd.Series, pieces: pd.Series, starts: pd.Series, ends: pd.Series, duration: pd.Series) -> pd.DataFrame:
    rows = []
    for w, p, s, e, long in zip(words, pieces, starts, ends, duration, strict=True):
        found = words_from_characters(list(w), list(zip(p, s.tolist(), e.tolist(), strict=True)), float(long))
        rows.append((None, None, None) if found is None else ([s for s, _ in found[0]], [e for _, e in found[0]], found[1]))
    return pd.DataFrame(rows, columns=PLACED.names)


def align_characters(expected: DataFrame, observed: DataFrame, crops: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, index, start, end, mode) of expected words (doc_id, index, token) from observed pieces (doc_id, index,
    token, start, end) and crops (doc_id, duration) (W16). by: columns that tell crops apart, in all three."""

    def listed(side: DataFrame, name: str, *columns: str) -> DataFrame:
        return side.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("index", *columns))).alias(name))

    # a crop's words and pieces meet in one row, and a batch of crops is aligned at once
    nan = F.lit(float("nan"))
    timed = fresh(observed, *by, "index", "token", "start", "end").withColumns({c: F.coalesce(F.col(c).cast("double"), nan) for c in ("start", "end")})
    both = listed(fresh(expected, *by, "index", "token"), "l", "token").join(fresh(crops, *by, "duration"), list(by)).join(listed(timed, "r", "token", "start", "end"), list(by))
    found = both.withColumn("x", _placed("l.token", "r.token", "r.start", "r.end", F.coalesce(F.col("duration").cast("double"), nan)))
    found = found.filter("x.mode is not null").select(*by, "x.mode", F.explode(F.arrays_zip(F.col("l.index").alias("index"), F.col("x.start").alias("start"), F.col("x.end").alias("end"))).alias("w"))
    return found.select(*by, F.col("w.index").cast("bigint").alias("index"), "w.start", "w.end", "mode")


def bisected(segments: DataFrame) -> DataFrame:
    """Both halves of segments that failed (G7): ids end in .0 and .1; a single word can't be halved."""
    half = F.expr("word_start + (word_end - word_start) div 2")
    both = F.array(F.struct(F.lit(0).alias("k"), F.col("word_start").alias("a"), half.alias("b")), F.struct(F.lit(1).alias("k"), half.alias("a"), F.col("word_end").alias("b")))
    out = segments.filter("word_end - word_start > 1").withColumn("h", F.explode(both))
    return out.withColumns({"segment_id": F.concat_ws(".", "segment_id", F.col("h.k").cast("string")), "word_start": F.col("h.a"), "word_end": F.col("h.b")}).drop("h")


def bisect_until(segments: DataFrame, fails, most_words: int) -> DataFrame:
    """Segments halved as long as they fail (G7, X7), with `mode`: exact, or fallback for single words that fail.

    fails: a function that adds a boolean column `failed` to segments; most_words: words of the longest segment. A
    segment of n words is halved ceil(log2(n)) times at most, so that many rounds make the plan; ids end in the path.
    """
    todo, done = segments, []
    for _ in range(max(1, most_words - 1).bit_length() + 1):
        tried = fails(todo)
        done.append(tried.filter(~F.col("failed") | (F.col("word_end") - F.col("word_start") <= 1)))
        todo = bisected(tried.filter("failed").drop("failed"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("mode", F.when(F.col("failed"), "fallback").otherwise("exact")).drop("failed")


def has_descendants(segments: DataFrame, done: DataFrame) -> DataFrame:
    """Segments of which any descendant (id + ".…") is done (G7); ancestors are unrolled, so the join is by equality."""
    parts = F.split("segment_id", r"\.")
    ancestors = done.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.when(F.size(parts) > k, F.array_join(F.slice(parts, 1, k), ".")))).alias("segment_id")).filter("segment_id is not null").distinct()
    return segments.join(ancestors, ["doc_id", "segment_id"], "left_semi")


def retry_windows(windows: DataFrame, overlap: float = 1.5) -> DataFrame:
    """Both halves of windows that failed, each reaching `overlap` over the middle."""
    middle = (F.col("start") + F.col("end")) / 2
    halves = F.array(F.struct(F.lit(0).alias("half"), F.col("start").alias("s"), F.least("end", middle + overlap).alias("e")), F.struct(F.lit(1).alias("half"), F.greatest("start", middle - overlap).alias("s"), F.col("end").alias("e")))
    return windows.withColumn("h", F.explode(halves)).withColumns({"half": F.col("h.half"), "start": F.col("h.s"), "end": F.col("h.e")}).drop("h")


def merged_retries(halves: DataFrame) -> DataFrame:
    """(doc_id, window_index, text, ok, reasons, accepted_empty) of windows whose halves were transcribed anew (G9):
    (doc_id, window_index, half, text, duration). The halves are stitched and the gate asked again; a blank window of
    2.5 s or less passes."""
    from wordloom.operators.quality import transcript_quality
    from wordloom.operators.transcripts import stitch

    keys = ("doc_id", "window_index")
    texts = halves.groupBy(*keys).agg(F.max("duration").alias("duration")).join(stitch(halves, "half", by=keys), list(keys), "left")
    texts = texts.withColumn("text", F.coalesce("text", F.lit("")))
    judged = transcript_quality(texts.select(F.struct(*keys).alias("doc_id"), "text", "duration"), F.col("duration")).select("doc_id.*", "ok", "reasons")
    both = texts.join(judged, list(keys))
    empty = (F.col("text") == "") & (F.col("duration") <= 2.5)
    none = F.array().cast("array<string>")
    return both.select(*keys, "text", (F.col("ok") | empty).alias("ok"), F.when(empty, none).otherwise(F.col("reasons")).alias("reasons"), empty.alias("accepted_empty"))
