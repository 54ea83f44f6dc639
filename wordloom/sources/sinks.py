"""Writers. Spark's commit protocol makes each all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """(K1, K6)"""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """(K1)"""
    df.write.mode("overwrite").json(path)


def write_texts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ()) -> None:
    """One folder per key with the text as it is: transcripts, chunks, VTT and ASS files (K3, K4, K5)."""
    named = df.select(F.col(text).alias("value"), *[F.col(c) for c in (key, *columns)])
    named.write.mode("overwrite").option("lineSep", "\n").partitionBy(key, *columns).text(path)


def transcript_lines(chunked: DataFrame) -> DataFrame:
    """(doc_id, chunk, text): the lines of every chunk of a transcript, to be written as a file each (K5)."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    return chunked.groupBy("doc_id", "chunk").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def copy_path(spark: SparkSession, source: str, target: str) -> None:
    """Copies a file or folder through Hadoop's file systems: whole under another name first, then renamed (K2)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    begin, end = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    part = end.suffix(".copying")
    here, there = begin.getFileSystem(conf), end.getFileSystem(conf)
    there.delete(part, True)
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(here, begin, there, part, False, conf):
        raise OSError(f"{source} was not copied")
    there.delete(end, True)
    if not there.rename(part, end):
        raise OSError(f"{target} was not put in place")
