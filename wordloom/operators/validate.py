"""Rules that a word-timings document must meet, as a table of violations: (doc_id, rule, index)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SLACK = 1e-6


def in_order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("index")


def _not(ok: Column) -> Column:
    return ~F.coalesce(ok, F.lit(False))


def _listed(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """One row per rule broken; all rules of a table are tested in one pass."""
    found = F.explode(F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))).alias("rule")
    return df.select("doc_id", found, F.col("index").cast("bigint").alias("index"))


def word_violations(words: DataFrame, docs: DataFrame) -> DataFrame:
    """Rules C2 to C8 on words; docs: (doc_id, duration)."""
    w = words.join(docs.select("doc_id", "duration"), "doc_id")
    w = w.withColumns({"_end": F.lag("end").over(in_order()), "_focus": F.lag("focus_end").over(in_order()), "_place": F.row_number().over(in_order()) - 1})
    numbers = [F.col(c) for c in ("start", "end", "focus_start", "focus_end")]
    finite = F.lit(True)
    for n in numbers:
        finite = finite & n.isNotNull() & ~F.isnan(n) & (F.abs(n) < F.lit(float("inf")))
    return _listed(w, [
        ("C2", _not(F.col("index") == F.col("_place"))),
        ("C3", _not((F.trim("text") != "") & (F.col("clean") != "") & (F.col("source") != ""))),
        ("C4", ~finite),
        ("C5", _not((F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("duration")))),
        ("C6", F.coalesce(F.col("start") < F.col("_end") - SLACK, F.lit(False))),
        ("C7", _not((F.col("focus_start") >= 0) & (F.col("focus_start") < F.col("focus_end")) & (F.col("focus_end") <= F.col("duration")))),
        ("C8", F.coalesce(F.col("focus_start") < F.col("_focus") - SLACK, F.lit(False))),
    ])


def range_violations(spans: DataFrame, words: DataFrame, rule: str = "C9") -> DataFrame:
    """Ranges (doc_id, index, word_start, word_end) numbered from 0 that cover each word once, in order."""
    counts = words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    s = spans.join(counts, "doc_id").withColumns({"_place": F.row_number().over(in_order()) - 1, "_to": F.lag("word_end", 1).over(in_order()), "_next": F.lead("word_start").over(in_order())})
    ok = (F.col("index") == F.col("_place")) & (F.col("word_start") == F.coalesce("_to", F.lit(0))) & (F.col("word_start") < F.col("word_end")) & (F.col("word_end") <= F.col("n")) & (F.col("_next").isNotNull() | (F.col("word_end") == F.col("n")))
    return _listed(s, [(rule, _not(ok))])


def pointer_violations(words: DataFrame, spans: DataFrame, pointer: str = "sentence_index", rule: str = "C10") -> DataFrame:
    """Words whose pointer isn't the range that holds them."""
    held = spans.select("doc_id", F.col("index").alias("_range"), F.explode(F.expr("sequence(word_start, greatest(word_end - 1, word_start))")).alias("index"))
    both = words.join(held, ["doc_id", "index"], "left")
    return _listed(both, [(rule, _not(F.col(pointer) == F.col("_range")))])


def document_violations(docs: DataFrame, words: DataFrame, sentences: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents without words, sentences, chunks or a finite positive duration."""
    out = docs.select("doc_id", "duration")
    for k, table in enumerate((words, sentences, chunks)):
        out = out.join(table.groupBy("doc_id").agg(F.count(F.lit(1)).alias(f"_n{k}")), "doc_id", "left")
    d = F.col("duration")
    ok = (d > 0) & (d < F.lit(float("inf"))) & ~F.isnan(d) & (F.col("_n0") > 0) & (F.col("_n1") > 0) & (F.col("_n2") > 0)
    return _listed(out.withColumn("index", F.lit(None).cast("bigint")), [("C1", _not(ok))])


def violations(docs: DataFrame, words: DataFrame, sentences: DataFrame, chunks: DataFrame) -> DataFrame:
    """All rules, C1 to C11."""
    parts = [
        word_violations(words, docs), range_violations(sentences, words, "C9"), pointer_violations(words, sentences, "sentence_index", "C10"),
        range_violations(chunks, words, "C11"), pointer_violations(words, chunks, "chunk_index", "C11"),
    ]
    out = document_violations(docs, words, sentences, chunks)
    for part in parts:
        out = out.unionByName(part)
    return out


def is_cover(rows: DataFrame, column: str, size: str) -> DataFrame:
    """(doc_id, cover): do the numbers of a document make 0..size-1, each once (L6, L7)?"""
    n = F.count(F.lit(1))
    return rows.groupBy("doc_id").agg(((n == F.max(size)) & (F.count_distinct(column) == n) & (F.min(column) == 0) & (F.max(column) == n - 1)).alias("cover"))
