"""The tables at hand as recordings: what the operators' inputs are made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.plans.registry import table

#: A month of milliseconds: the recording of every user.
MONTH = 2_678_400_000
ORIGIN = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


def regions(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """(doc_id, event_id, start, end, event_type) in ms: an event lasts `value` times ten minutes."""
    events = table(spark, sf_dir, "events")
    events = events.filter(F.col("event_type").isin(*kinds)) if kinds else events
    start = F.expr(f"timestampdiff(MICROSECOND, {ORIGIN}, ts) div 1000")
    return events.select(F.col("user_id").alias("doc_id"), "event_id", start.alias("start"), (start + F.floor(F.col("value") * 600000).cast("bigint")).alias("end"), "event_type")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, duration)"""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")).distinct().withColumn("duration", F.lit(MONTH).cast("bigint"))


def timed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, index, text, start, end, duration, event_type) in seconds: a user's events in order, as words."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("start", "event_id")
    r = regions(spark, sf_dir).withColumn("index", (F.row_number().over(order) - 1).cast("bigint"))
    return r.select("doc_id", "index", F.concat(F.col("event_type"), F.lit("."), F.col("event_id").cast("string")).alias("text"), (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"), F.lit(MONTH / 1000).alias("duration"), "event_type")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, window_index, text): conversations as windows."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("window_index"), "text")


EV = """ev AS (
  SELECT user_id AS doc_id, event_id, event_type, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS "start",
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 + floor(value * 600000)::BIGINT AS "end"
  FROM events
), docs AS (SELECT DISTINCT doc_id, 2678400000 AS duration FROM ev)"""

WORDS = EV + """, tw AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY "start", event_id) - 1 AS index, event_type || '.' || event_id AS text,
         "start" / 1000.0::DOUBLE AS "start", "end" / 1000.0::DOUBLE AS "end", 2678400.0::DOUBLE AS duration, event_type
  FROM ev
)"""


def islands_sql(name: str, source: str, gap: int = 0, padding: int = 0, extra: str = "") -> str:
    """CTEs: `name` has the merged intervals of `source` (doc_id, start, end), as gaps and islands."""
    return f"""{name}_c AS (
  SELECT doc_id, greatest("start", 0) AS "start", least("end", 2678400000) AS "end" FROM {source} {extra}
), {name}_m AS (
  SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM {name}_c WHERE "end" > "start"
), {name}_i AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach + {gap} THEN 1 ELSE 0 END)
            OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM {name}_m
), {name} AS (
  SELECT doc_id, greatest(min("start") - {padding}, 0) AS "start", least(max("end") + {padding}, 2678400000) AS "end" FROM {name}_i GROUP BY doc_id, island
)"""


def complement_sql(name: str, source: str) -> str:
    """CTE: what `source` (doc_id, start, end; merged) leaves of the month."""
    return f"""{name} AS (
  SELECT doc_id, "start", "end" FROM (
    SELECT doc_id, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY "start", "end"), 0) AS "start", "start" AS "end"
    FROM (SELECT doc_id, "start", "end" FROM {source} UNION ALL SELECT doc_id, duration, duration FROM docs)
  ) WHERE "end" > "start"
)"""
