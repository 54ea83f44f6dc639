"""Algebra of half-open intervals (doc_id, start, end) and schedules over them.

Columns may be seconds (double) or any integer unit. Every window is partitioned by doc_id: one recording's intervals
are few, and recordings are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SO_FAR = Window.unboundedPreceding


def per_doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("start", "end")


def clamped(regions: DataFrame, duration: Column | str | float) -> DataFrame:
    """Cut to [0, duration]; intervals that are or become empty go."""
    limit = duration if isinstance(duration, Column) else F.col(duration) if isinstance(duration, str) else F.lit(duration)
    cut = regions.withColumns({"start": F.greatest("start", F.lit(0)), "end": F.least("end", limit)})
    return cut.filter(F.col("end") > F.col("start"))


def islands(regions: DataFrame, gap=0) -> DataFrame:
    """Unions of intervals that overlap or lie at most `gap` apart: (doc_id, island, start, end)."""
    reach = F.max("end").over(per_doc().rowsBetween(SO_FAR, -1))
    starts = F.coalesce((F.col("start") > reach + F.lit(gap)).cast("int"), F.lit(1))
    numbered = regions.withColumn("new_island", starts).withColumn("island", F.sum("new_island").over(per_doc().rowsBetween(SO_FAR, 0)))
    return numbered.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def merge_regions(regions: DataFrame, duration, padding=0, gap=0, digits: int | None = None) -> DataFrame:
    """Merged speech regions (I1): clamp, merge over gaps up to `gap` inclusive, then pad and clamp again.

    Padding can make neighbours overlap if it is more than half the gap; they aren't merged a second time.
    """
    merged = islands(clamped(regions, duration), gap).drop("island")
    if padding:
        merged = clamped(merged.withColumns({"start": F.col("start") - F.lit(padding), "end": F.col("end") + F.lit(padding)}), duration)
    return merged if digits is None else merged.withColumns({c: F.round(c, digits) for c in ("start", "end")})


def normalized(regions: DataFrame, duration) -> DataFrame:
    """Clamped and merged where they touch."""
    return merge_regions(regions, duration)


def complement(regions: DataFrame, docs: DataFrame, least=None, above=None) -> DataFrame:
    """What regions leave of [0, duration] in docs (doc_id, duration), with its first and last piece.

    least keeps pieces of at least that length; above, pieces that are longer.
    """
    merged = normalized(regions.select("doc_id", "start", "end").join(docs.select("doc_id", "duration"), "doc_id"), "duration")
    ends = docs.select("doc_id", F.col("duration").alias("start"), F.col("duration").alias("end"))
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    pieces = merged.select("doc_id", "start", "end").unionByName(ends)
    pieces = pieces.select("doc_id", F.lag("end", 1).over(order).alias("before"), F.col("start").alias("end"))
    pieces = pieces.select("doc_id", F.coalesce("before", F.lit(0)).cast(pieces.schema["end"].dataType).alias("start"), "end")
    length = F.col("end") - F.col("start")
    pieces = pieces.filter(length > 0)
    if least is not None:
        pieces = pieces.filter(length >= F.lit(least))
    return pieces if above is None else pieces.filter(length > F.lit(above))


def silence_candidates(speech: DataFrame, docs: DataFrame, threshold) -> DataFrame:
    """Stretches without speech of at least `threshold`, leading and trailing ones too."""
    return complement(speech, docs, least=threshold)


def kept_regions(cuts: DataFrame, docs: DataFrame, above=0.001) -> DataFrame:
    """What remains once cuts are taken out, but for slivers up to `above`."""
    return complement(cuts, docs, above=above)


def subtract_protected(candidates: DataFrame, protected: DataFrame, threshold) -> DataFrame:
    """Candidates less protected intervals; pieces shorter than `threshold` after the split go.

    An equi-join on doc_id carries the overlap condition; each candidate then yields the gaps between what covers it.
    """
    cover = islands(protected.filter(F.col("end") > F.col("start"))).select("doc_id", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    own = candidates.select("doc_id", F.col("start").alias("c_start"), F.col("end").alias("c_end")).distinct()
    hit = own.join(cover, "doc_id").filter((F.col("p_start") < F.col("c_end")) & (F.col("p_end") > F.col("c_start")))
    hit = hit.select("doc_id", "c_start", "c_end", F.greatest("p_start", "c_start").alias("start"), F.least("p_end", "c_end").alias("end"))
    stop = own.select("doc_id", "c_start", "c_end", F.col("c_end").alias("start"), F.col("c_end").alias("end"))
    order = Window.partitionBy("doc_id", "c_start", "c_end").orderBy("start", "end")
    piece = hit.unionByName(stop).select("doc_id", F.coalesce(F.lag("end").over(order), "c_start").alias("start"), F.col("start").alias("end"))
    return piece.filter((F.col("end") > F.col("start")) & (F.col("end") - F.col("start") >= F.lit(threshold)))


def cut_summary(cuts: DataFrame, docs: DataFrame, least=0.001) -> DataFrame:
    """Per document: cut_count, removed, output_duration and status (I10): no_cuts if nothing, or no more than `least`, goes;
    error if nothing would remain."""
    per = cuts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cut_count"), F.sum(F.col("end") - F.col("start")).alias("removed"))
    out = docs.join(per, "doc_id", "left").withColumns({"cut_count": F.coalesce("cut_count", F.lit(0)), "removed": F.coalesce("removed", F.lit(0))})
    kept = F.col("duration") - F.col("removed")
    status = F.when(F.col("removed") <= F.lit(least), "no_cuts").when(kept <= F.lit(least), "error").otherwise("cut")
    return out.select("doc_id", "cut_count", "removed", kept.alias("output_duration"), status.alias("status"))


def keep_expression(kept: DataFrame, digits: int = 3) -> DataFrame:
    """between(t,a,b)+... per document: the filter that selects kept regions in a renderer (K8)."""
    part = F.format_string(f"between(t,%.{digits}f,%.{digits}f)", F.col("start").cast("double"), F.col("end").cast("double"))
    ordered = F.array_sort(F.collect_list(F.struct("start", part.alias("part"))))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "+").alias("expression"))


def _starts(length: Column, window, step) -> Column:
    """Starts, relative to 0, of windows until one reaches `length`: ceil((length - window) / step) + 1 of them, at least one."""
    more = F.greatest(F.ceil((length - F.lit(window)) / F.lit(step)), F.lit(0)).cast("int")
    kind = "bigint" if isinstance(step, int) else "double"
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), more), lambda k: k * F.lit(step).cast(kind))).otherwise(F.array().cast(f"array<{kind}>"))


def fixed_windows(docs: DataFrame, window, overlap=0) -> DataFrame:
    """Windows of fixed length over [0, duration], the last one cut off (I6; I8 with overlap 0)."""
    step = window - overlap
    at = docs.select("doc_id", "duration", F.posexplode(_starts(F.col("duration"), window, step)).alias("window_index", "start"))
    return at.select("doc_id", F.col("window_index").cast("bigint").alias("window_index"), "start", F.least(F.col("start") + F.lit(window), "duration").alias("end"))


def region_windows(regions: DataFrame, window, overlap=0) -> DataFrame:
    """Windows that start anew with every region and never leave it, numbered through per document."""
    step = window - overlap
    length = F.col("end") - F.col("start")
    at = regions.select("doc_id", F.col("start").alias("from"), F.col("end").alias("to"), F.explode(_starts(length, window, step)).alias("rel"))
    at = at.select("doc_id", (F.col("from") + F.col("rel")).alias("start"), F.least(F.col("from") + F.col("rel") + F.lit(window), "to").alias("end"))
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    return at.withColumn("window_index", (F.row_number().over(order) - 1).cast("bigint"))


def shifted(regions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Intervals relative to a chunk (doc_id, chunk, start, end) made absolute by the chunk's offset."""
    return regions.join(chunks.select("doc_id", "chunk", "offset"), ["doc_id", "chunk"]).select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end")
    )


def overlap_join(left: DataFrame, right: DataFrame, bucket) -> DataFrame:
    """Pairs of overlapping intervals with the part they share (J6): columns of left, r_start, r_end, start, end.

    Both sides are spread over the buckets of that length which they touch, so that the join has an equi key even
    within one long document; a pair counts in the bucket where its common part begins.
    """
    bucket = F.lit(bucket)

    def spread(side: DataFrame) -> DataFrame:
        return side.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.greatest(F.ceil(F.col("end") / bucket) - 1, F.floor(F.col("start") / bucket)))))

    a = spread(left.withColumnsRenamed({"start": "l_start", "end": "l_end"}).withColumns({"start": F.col("l_start"), "end": F.col("l_end")})).drop("start", "end")
    b = spread(right).select("doc_id", "bucket", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    start, end = F.greatest("l_start", "r_start"), F.least("l_end", "r_end")
    return (
        a.join(b, ["doc_id", "bucket"])
        .filter((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.floor(start / bucket) == F.col("bucket")))
        .withColumns({"start": start, "end": end})
        .drop("bucket")
    )


def total_length(regions: DataFrame) -> DataFrame:
    """Sum of lengths per document (A3)."""
    return regions.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("total"))
