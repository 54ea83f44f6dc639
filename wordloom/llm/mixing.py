"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm.common import WORD, table, unused, written

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: A source is taken so many times over at most.
EPOCHS = 3
#: Words of a block, the same at every size of the input.
BLOCK_WORDS = 1024
#: 2**32 over the golden ratio, to the next odd number: slot t's point is the fraction of t times it, in 2**32nds.
STEP, FULL = 2654435769, 1 << 32
#: Points are looked up in so many equal parts of the unit interval.
CELLS = 4096


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size is the number of words, 0 of a null text."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", words.alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """(place, source, source_size, target, low, high) per source; [low, high) is its part of the 2**32 points.

    Targets share the size of all by weight; none is over EPOCHS times its source's size, and what is over goes to
    the others by weight, until none is above. So all but the capped have one level of target per weight: sources
    are capped in the order of cap per weight, as long as the level of the rest is higher. All sums are integers.
    One task sees a row for each source, which is little for as many as millions of sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    source = source.withColumn("place", F.row_number().over(by_name).cast("long"))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), (F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    source = source.select("place", "source", "source_size", weight.alias("weight"), (F.col("source_size") * EPOCHS).alias("cap"))
    # by cap per weight, compared as integers: cap * (product of the weights / weight)
    common = math.lcm(*WEIGHTS)
    rank = (F.col("cap") * F.expr(f"{common} div weight")).alias("rank")
    every = Window.partitionBy(F.lit(1))
    below = Window.orderBy("rank", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    source = source.withColumn("rank", rank).select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.sum("weight").over(every).alias("weights"),
        F.sum("cap").over(below).alias("caps_to_here"),
        F.sum("weight").over(below).alias("weights_to_here"),
    )
    # capped if, with all before it capped, it would get its cap or more
    over = F.col("cap") * (F.col("weights") - F.col("weights_to_here") + F.col("weight")) <= F.col("weight") * (F.col("total") - F.col("caps_to_here") + F.col("cap"))
    source = source.withColumn("capped", over)
    source = source.select(
        "*",
        (F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)).alias("num"),
        (F.col("weights") - F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(every)).alias("den"),
    ).withColumn("den", F.greatest("den", F.lit(1)))
    upto = by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.when(F.col("capped"), F.col("cap") * F.col("den")).otherwise(F.col("num") * F.col("weight"))  # target * den
    source = source.withColumn("share", share).withColumn("upto", F.sum("share").over(upto)).withColumn("shares", F.sum("share").over(every))

    def point(part: Column) -> Column:
        return F.when(F.col("shares") > 0, F.ceil(part.cast("double") / F.col("shares").cast("double") * F.lit(float(FULL)))).otherwise(0)

    return source.select(
        "place", "source", "source_size", (F.col("share").cast("double") / F.col("den").cast("double")).alias("target"),
        point(F.col("upto") - F.col("share")).alias("low"), point(F.col("upto")).alias("high"),
    )


def schedule(spark: SparkSession, source: DataFrame, slots: int) -> DataFrame:
    """(slot, place, nth): the source of every slot and the slot's rank among those of its source, from 0.

    Slots are ranked in two steps, within runs of about sqrt(slots) slots and then by the runs' counts, so that no
    task has all slots of a source.
    """
    t = F.col("slot")
    # t * STEP mod 2**32 without overflow
    point = F.pmod(F.pmod(t, F.lit(65536)) * STEP + F.pmod(F.expr("slot div 65536") * STEP, F.lit(65536)) * 65536, F.lit(FULL))
    width = FULL // CELLS
    points = spark.range(slots).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", F.expr(f"point div {width}"))
    cells = source.filter("high > low").select("place", "low", "high", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))).alias("cell"))
    run = 1 << max(6, int(math.log2(max(slots, 1))) // 2)
    placed = points.join(cells, "cell").filter("point >= low and point < high").select("slot", "place", F.expr(f"slot div {run}").alias("run"))
    counts = placed.groupBy("place", "run").agg(F.count(F.lit(1)).alias("own"))
    before = counts.select("place", "run", (F.sum("own").over(Window.partitionBy("place").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("own")).alias("before"))
    within = placed.withColumn("nth", F.row_number().over(Window.partitionBy("place", "run").orderBy("slot")))
    return within.join(before, ["place", "run"]).select("slot", "place", (F.col("nth") + F.col("before") - 1).alias("nth"))


def shuffled(sizes: DataFrame, source: DataFrame, rows: int) -> DataFrame:
    """(doc_id, place, size, begin): each source's documents in hashed order, and the words of the source before them.

    Sums are taken in two steps, within about sqrt(rows) ranges of the hash and then over the ranges' totals.
    """
    ranges = 1 << max(6, math.ceil(math.log2(max(rows, 1)) / 2))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    placed = sizes.join(source.select("place", "source"), sizes["source"].eqNullSafe(source["source"])).select("doc_id", "place", "size", order.alias("ord"))
    placed = placed.withColumn("range", F.shiftright(F.conv(F.substring("ord", 1, 12), 16, 10).cast("long"), 48 - int(math.log2(ranges))))
    totals = placed.groupBy("place", "range").agg(F.sum("size").alias("own"))
    so_far = Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = totals.select("place", "range", (F.sum("own").over(so_far) - F.col("own")).alias("before"))
    within = Window.partitionBy("place", "range").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("nth", F.row_number().over(within)).withColumn("within", F.sum("size").over(within) - F.col("size"))
    return placed.join(before, ["place", "range"]).select("doc_id", "place", "size", (F.col("within") + F.col("before")).alias("begin"))


def taken_pieces(docs: DataFrame, block: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, size, source_size, target) of every row of `docs`, and (row, pass, slot, words): what the mix takes
    of it, by pass over its source and by the schedule's slot.

    Each source is a circle of words, its documents in hashed order, passed EPOCHS times at most and cut into blocks
    of equal size. The schedule's slots go to sources by golden-ratio points, so that any stretch of it has nearly
    the target weights; a source's nth slot takes its nth block, up to its target. Where its slots end short of the
    target (by a few blocks, or because a small source's target is less than one), the rest follows the last slot.
    Blocks are joined with the documents they overlap.
    """
    spark = docs.sparkSession
    sizes = written(sized(docs))
    source = written(targets(sizes))
    rows, total = sizes.agg(F.count(F.lit(1)), F.sum("size")).first()
    slots = -(-(total or 0) // block)
    blocks = schedule(spark, source, slots).select("place", F.col("nth").alias("block"), "slot")
    limits = source.select("place", "source_size", "target", F.least(F.lit(EPOCHS) * F.col("source_size"), F.ceil("target")).alias("most"))
    begun = written(shuffled(sizes, source, rows).join(limits, "place").withColumn("row", F.monotonically_increasing_id()))
    passes = F.expr(f"sequence(0, cast(least({EPOCHS} - 1, (most - 1) div greatest(source_size, 1)) as int))")
    spans = begun.filter("size > 0 and most > 0").select("row", "place", "size", "most", "begin", "source_size", F.explode(passes).alias("pass"))
    spans = spans.withColumn("at", F.col("begin") + F.col("pass") * F.col("source_size")).select("row", "place", "pass", "at", F.least(F.col("at") + F.col("size"), "most").alias("end")).filter("end > at")
    pieces = spans.select("row", "place", "pass", "at", "end", F.explode(F.expr(f"sequence(at div {block}, (end - 1) div {block})")).alias("block"))
    overlap = F.least("end", (F.col("block") + 1) * block) - F.greatest("at", F.col("block") * block)
    pieces = pieces.join(blocks, ["place", "block"], "left").select("row", "pass", F.coalesce("slot", F.lit(slots)).alias("slot"), overlap.alias("words"))
    return begun.select("row", "doc_id", "size", "source_size", "target"), pieces


def mix(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted),
    first_slot (the schedule's slot where it is first taken; null if it isn't).

    A document may be taken in part where its source's target ends. Null sources are one source, the last; a null text
    has size 0; repeated rows count each; without words nothing is taken; an empty table gives none.
    """
    begun, pieces = taken_pieces(docs, block)
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    return begun.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")


def mixed_documents(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """`docs` in the order of the mix: a row for each whole time, rounded, that it takes a document, placed by the slots
    where it is taken; columns as they were, whatever their names.

    Whether a document is taken at all, and how often, depends on its id and size alone, so that rows which repeat
    an id share what it is taken. Null texts and texts without words are never taken.
    """
    begun, pieces = taken_pieces(docs, block)
    by_pass = pieces.groupBy("row", "pass").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    of_row = by_pass.groupBy("row").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list("slot")).alias("slots"))
    times = begun.join(of_row, "row", "left").groupBy("doc_id").agg(
        F.round(F.sum(F.coalesce("taken", F.lit(0))) / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias("times"), F.max("slots").alias("slots")
    ).filter("times > 0")
    mixed, slot = unused(docs, "mixed_id"), unused(docs, "mixed_slot")
    # the nth time is placed at the nth slot; of a document that is rounded up, the last one again
    at = F.transform(F.sequence(F.lit(1), "times"), lambda n: F.get("slots", F.least(n, F.size("slots")) - 1))
    often = times.select(F.col("doc_id").alias(mixed), at.alias(slot))
    both = docs.join(often, docs["doc_id"].eqNullSafe(often[mixed])).withColumn(slot, F.explode(slot))
    return both.orderBy(slot, mixed).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s1 AS (
  SELECT row_number() OVER (ORDER BY source NULLS LAST) AS place, source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), s2 AS (
  SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s1
), s3 AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights,
         sum(cap) OVER below::BIGINT AS caps_to_here, sum(weight) OVER below::BIGINT AS weights_to_here
  FROM s2 WINDOW below AS (ORDER BY cap * (6 // weight), place ROWS UNBOUNDED PRECEDING)
), s4 AS (
  SELECT *, cap * (weights - weights_to_here + weight) <= weight * (total - caps_to_here + cap) AS capped FROM s3
), s5 AS (
  SELECT *, (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::BIGINT AS num,
         greatest(weights - sum(CASE WHEN capped THEN weight ELSE 0 END) OVER (), 1)::BIGINT AS den
  FROM s4
), s6 AS (
  SELECT *, CASE WHEN capped THEN cap * den ELSE num * weight END AS share FROM s5
), s7 AS (
  SELECT *, sum(share) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, sum(share) OVER ()::BIGINT AS shares FROM s6
), src AS (
  SELECT place, source, source_size, total, share::DOUBLE / den::DOUBLE AS target,
         ceil((upto - share)::DOUBLE / shares::DOUBLE * 4294967296.0)::BIGINT AS low, ceil(upto::DOUBLE / shares::DOUBLE * 4294967296.0)::BIGINT AS high
  FROM s7
), par AS (
  SELECT (max(total) + 1023) // 1024 AS slots FROM src
), slots AS (
  SELECT unnest(range((SELECT slots FROM par))) AS slot
), taken_blocks AS (
  SELECT place, slot, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS block
  FROM slots JOIN src ON (slot * 2654435769) % 4294967296 >= low AND (slot * 2654435769) % 4294967296 < high
), docs AS (
  SELECT doc_id, size, src.*, least(3 * source_size, ceil(target)::BIGINT) AS words,
         sum(size) OVER (PARTITION BY place ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS begun
  FROM sizes JOIN src ON sizes.source IS NOT DISTINCT FROM src.source
)
SELECT doc_id, size, source_size, target,
       (least(greatest(words - begun, 0), size) + least(greatest(words - begun - source_size, 0), size)
        + least(greatest(words - begun - 2 * source_size, 0), size))::BIGINT AS taken,
       CASE WHEN size > 0 AND words > begun THEN coalesce(slot, slots) END AS first_slot
FROM docs CROSS JOIN par LEFT JOIN taken_blocks ON taken_blocks.place = docs.place AND taken_blocks.block = begun // 1024
"""
