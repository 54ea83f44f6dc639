"""Runs that can be taken up again: fingerprints, what is done, what is missing, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.identity import fingerprint


def stage_fingerprints(stages: DataFrame) -> DataFrame:
    """Adds `fingerprint` to stages (name, schema_version, inputs, settings, models) (H3): alike for equal values only."""
    return stages.withColumn("fingerprint", fingerprint(stages, "name", "schema_version", "inputs", "settings", "models"))


def missing(schedule: DataFrame, results: DataFrame, keys: tuple[str, ...] = ("doc_id", "window_index")) -> DataFrame:
    """Scheduled rows without a result."""
    return schedule.join(results.select(*keys).distinct(), list(keys), "left_anti")


def resumable(schedule: DataFrame, results: DataFrame, tolerance=0.002, keys: tuple[str, ...] = ("doc_id", "window_index")) -> DataFrame:
    """Results that can be used again (J10, P11): scheduled, within the tolerance, with a text and passed."""
    s = schedule.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    near = (F.abs(F.col("start") - F.col("_s")) <= tolerance) & (F.abs(F.col("end") - F.col("_e")) <= tolerance)
    return results.join(s, list(keys)).filter(near & F.col("text").isNotNull() & F.col("ok")).drop("_s", "_e")


def valid_segments(segments: DataFrame) -> DataFrame:
    """(doc_id, segment_id, valid) of stored items (doc_id, segment_id, word_index, start, end)."""
    n, limit = F.count(F.lit(1)), F.lit(float("inf"))
    sound = (F.abs("start") < limit) & (F.abs("end") < limit) & (F.col("end") >= F.col("start"))
    return segments.groupBy("doc_id", "segment_id").agg(((n == F.count_distinct("word_index")) & F.bool_and(F.coalesce(sound, F.lit(False)))).alias("valid"))


def valid_layouts(layouts: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, sentence_index, valid) of measured layouts (P13, D12): as many words as the sentence, the same texts, finite
    numbers, and sizes above 0. words: array of structs; sentences: (doc_id, sentence_index, texts)."""
    limit = F.lit(float("inf"))
    names = ("x", "y", "width", "height", "textX", "textY", "textWidth", "textHeight", "fontSize")

    def sound(w):
        ok = F.lit(True)
        for name in names:
            ok = ok & F.coalesce(F.abs(w[name]) < limit, F.lit(False))
        return ok & (w["width"] > 0) & (w["height"] > 0) & (w["fontSize"] > 0)

    both = layouts.join(sentences, ["doc_id", "sentence_index"], "left")
    same = F.transform("words", lambda w: w["text"]).eqNullSafe(F.col("texts"))
    return both.select("doc_id", "sentence_index", (F.coalesce(same, F.lit(False)) & F.forall("words", sound)).alias("valid"))


def valid_artifacts(checkpoints: DataFrame, files: DataFrame) -> DataFrame:
    """(fingerprint, valid): are all artifacts of a checkpoint (fingerprint, artifacts: path, sha256) there and unchanged,
    and none outside its folder (P16, D14)? files: (path, sha256)."""
    listed = checkpoints.select("fingerprint", F.explode_outer("artifacts").alias("a")).select("fingerprint", "a.path", F.col("a.sha256").alias("want"))
    both = listed.join(files.select("path", F.col("sha256").alias("have")), "path", "left")
    inside = ~F.col("path").startswith("/") & ~F.array_contains(F.split("path", "/"), "..")
    ok = F.coalesce((F.col("want") == F.col("have")) & inside, F.lit(False))
    return both.groupBy("fingerprint").agg(F.bool_and(ok).alias("valid"))


def resume_counts(done: DataFrame, wanted: DataFrame, key: str = "segment_id") -> DataFrame:
    """(doc_id, resumed, new): ids in both, and only in wanted."""
    both = wanted.select("doc_id", key).distinct().join(done.select("doc_id", key).distinct().withColumn("_d", F.lit(1)), ["doc_id", key], "left")
    return both.groupBy("doc_id").agg(F.count("_d").alias("resumed"), F.count_if(F.col("_d").isNull()).alias("new"))


def unknown_keys(given: DataFrame, known: DataFrame) -> DataFrame:
    """(L5)"""
    return given.select("key").exceptAll(known.select("key"))


def run_state(events: DataFrame) -> DataFrame:
    """One row per run (D13, K6) from its log (job_id, seq, kind, stage, status, fingerprint, message): the last status of
    every stage, its warnings once each in order, and whether it is complete."""
    last = events.filter("kind = 'stage'").groupBy("job_id", "stage").agg(F.max_by(F.struct("status", "fingerprint"), "seq").alias("s"))
    stages = last.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "s")))).alias("stages"), F.bool_and(F.col("s.status").isin("complete", "reused")).alias("all_complete"))
    first = events.filter("kind = 'warning'").groupBy("job_id", "message").agg(F.min("seq").alias("seq"))
    warnings = first.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "message"))), lambda w: w["message"]).alias("warnings"))
    return stages.join(warnings, "job_id", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))


# Schema version and states of the documents that runs leave.
SCHEMA_VERSION = 1


def checkpoint_documents(stages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(job_id, stage, document): the JSON of a finished stage (K6, D14), to be written as it is. stages: (job_id, stage,
    fingerprint, completed_at, elapsed_seconds); artifacts: (job_id, stage, path, sha256, size_bytes), none of which may
    lie outside its folder: a stage with such a one has no document."""
    inside = ~F.col("path").startswith("/") & ~F.array_contains(F.split("path", "/"), "..")
    listed = artifacts.groupBy("job_id", "stage").agg(F.bool_and(inside).alias("inside"), F.array_sort(F.collect_list(F.struct("path", "sha256", "size_bytes"))).alias("artifacts"))
    both = stages.join(listed, ["job_id", "stage"], "left").filter(F.coalesce("inside", F.lit(True)))
    none = F.array().cast("array<struct<path:string,sha256:string,size_bytes:bigint>>")
    document = F.to_json(F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "fingerprint", F.lit("complete").alias("status"), "completed_at", F.round("elapsed_seconds", 3).alias("elapsed_seconds"), F.coalesce("artifacts", none).alias("artifacts"),
    ))
    return both.select("job_id", "stage", document.alias("document"))


def manifest_documents(runs: DataFrame, events: DataFrame) -> DataFrame:
    """(job_id, document): the JSON of every run (K6, D13) from (job_id, fingerprint) and its log, as run_state reads it: a run
    is complete if all its stages are, failed if one has failed, else running."""
    state = run_state(events)
    both = runs.join(state, "job_id", "left")
    stages = F.coalesce("stages", F.map_from_entries(F.array().cast("array<struct<a:string,b:struct<status:string,fingerprint:string>>>")))
    failed = F.exists(F.map_values(stages), lambda s: s["status"] == "failed")
    status = F.when(F.coalesce("all_complete", F.lit(False)), "complete").when(failed, "failed").otherwise("running")
    document = F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "job_id", "fingerprint", status.alias("status"), stages.alias("stages"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings")))
    return both.select("job_id", document.alias("document"))


def log_lines(events: DataFrame) -> DataFrame:
    """(job_id, line): a run's messages with their UTC stamps, in order, a line each (K9); events: (job_id, seq, at, message)."""
    line = F.concat(F.lit("["), F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00] "), F.col("message"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return events.groupBy("job_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def materialised(spark: SparkSession, root: str, fingerprint: str, build) -> DataFrame:
    """The table of a fingerprint (X1): read where it has been written whole, else built, written and read.

    `root` must be a folder that all executors share; Spark's commit marker tells whether a write was finished.
    """
    path = f"{root.rstrip('/')}/{fingerprint}"
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
