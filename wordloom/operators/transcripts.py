"""Transcripts: words, sentences, chunks, and the stitching of overlapping windows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from wordloom.functions import text as T


def word_index(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, index, text, clean, sentence_index) of a transcript with a sentence a line.

    Blank lines don't count, nor do tokens with neither letter, digit nor apostrophe. A byte order mark is dropped.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace(text_col, "^﻿", ""), "\n")).alias("line", "t"))
    # lines move as they are, with clean words (which hold no blanks) only where Python has to make them; words are neither moved nor sorted
    lines = lines.filter(F.col("t").rlike(T.NOT_BLANK)).withColumn("made", F.array_join(T.odd_clean_words(F.col("t")), " "))
    lines = lines.repartition("doc_id").sortWithinPartitions("doc_id", "line")
    order = Window.partitionBy("doc_id").orderBy("line")
    lines = lines.withColumn("sentence_index", (F.row_number().over(order) - 1).cast("bigint")).withColumn("words", T.tokens(F.col("t")))
    clean = F.coalesce(F.split("made", " "), F.transform("words", T.plain_clean_word))
    lines = lines.withColumn("words", F.filter(F.arrays_zip(F.col("words").alias("text"), clean.alias("clean")), lambda w: w["clean"] != ""))
    before = F.sum(F.size("words")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.size("words")
    words = lines.select("doc_id", "sentence_index", before.alias("before"), "words").select("doc_id", "sentence_index", "before", F.posexplode("words").alias("pos", "w"))
    return words.select("doc_id", (F.col("before") + F.col("pos")).alias("index"), "w.text", "w.clean", "sentence_index")


def ranges(words: DataFrame, group: str = "sentence_index") -> DataFrame:
    """(doc_id, group, word_start, word_end, text): half-open word ranges."""
    ordered = F.array_sort(F.collect_list(F.struct("index", "text")))
    return words.groupBy("doc_id", group).agg(
        F.min("index").alias("word_start"), (F.max("index") + 1).alias("word_end"), F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text")
    )


def sentence_ranges(words: DataFrame, keep_ends: str | None = None) -> DataFrame:
    """Words with `sentence`, the number of sentence ends before them.

    keep_ends names a column whose last word always ends a sentence, as the sentences of an earlier split do.
    """
    order = Window.partitionBy("doc_id").orderBy("index")
    ends = T.is_sentence_boundary(F.col("text"), F.lead("text").over(order))
    if keep_ends:
        ends = ends | F.coalesce(F.lead(keep_ends).over(order) != F.col(keep_ends), F.lit(True))
    words = words.withColumn("ends", ends.cast("int"))
    before = F.sum("ends").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return words.withColumn("sentence", F.coalesce(before, F.lit(0))).drop("ends")


def assign_ranges(words: DataFrame, spans: DataFrame, number: str) -> DataFrame:
    """Words with the number of the range that holds them (J5): ranges are unrolled, so the join is by equality."""
    unrolled = spans.filter("word_end > word_start").select("doc_id", F.col(number), F.explode(F.expr("sequence(word_start, word_end - 1)")).alias("index"))
    return words.join(unrolled, ["doc_id", "index"], "left")


def chunk_sources(files: DataFrame) -> DataFrame:
    """Chunk files (path, text) by the number in their name, without hidden ones and [tags]."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    number = F.regexp_extract(stem, "([0-9]+)", 1)
    chosen = files.filter(name.rlike(r"^chunk_.*\.txt$"))
    return chosen.select(number.try_cast("int").alias("chunk_index"), name.alias("file"), T.squeezed(T.strip_tags(F.col("text"))).alias("text")).orderBy("file")


def sequence_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positions at which two token streams (doc_id, index, text) differ or only one has a token."""
    a, b = left.select("doc_id", "index", F.col("text").alias("left")), right.select("doc_id", "index", F.col("text").alias("right"))
    return a.join(b, ["doc_id", "index"], "full").filter(~F.col("left").eqNullSafe(F.col("right")))


# ---- folds over an ordered array: short per document, so they stay one expression on the JVM ----


def overlap_length(left: Column, right: Column, most: int = 48) -> Column:
    """Words, 2 to `most`, in which the end of `left` equals the start of `right`; 0 if none (G1). Arrays of join keys."""
    sizes = F.when(F.least(F.size(left), F.size(right)) >= 2, F.sequence(F.lit(2), F.least(F.lit(most), F.size(left), F.size(right)))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_max(F.filter(sizes, lambda k: F.slice(left, -k, k) == F.slice(right, 1, k))), F.lit(0))


def stitch(windows: DataFrame, order: str = "window_index", most: int = 48, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, text): windows joined in order, the repeated start of each dropped (G1); by: what they are joined within."""
    text = F.col("text")
    keyed = windows.filter(F.size(T.tokens(text)) > 0).select(*by, order, F.transform(F.arrays_zip(T.tokens(text).alias("text"), T.stitch_keys(text).alias("key")), lambda w: F.struct(w["text"].alias("text"), w["key"].alias("key"))).alias("words"))
    parts = keyed.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "words"))), lambda x: x["words"]).alias("parts"))
    empty = F.array().cast("array<struct<text:string,key:string>>")

    def keys(a: Column) -> Column:
        return F.transform(a, lambda w: w["key"])

    def add(done: Column, part: Column) -> Column:
        size = F.size(part)
        return F.concat(done, F.slice(part, overlap_length(keys(F.slice(done, F.greatest(F.size(done) - most, F.lit(0)) + 1, F.lit(most))), keys(part), most) + 1, size))

    joined = F.aggregate("parts", empty, add)
    return parts.select(*by, F.array_join(F.transform(joined, lambda w: w["text"]), " ").alias("text"))


def pack_chunks(lines: DataFrame, most: int = 300, order: str = "line", count: str = "words") -> DataFrame:
    """Lines with their chunk (G2): a new one begins when the next line would make it more than `most` words."""
    listed = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(count).cast("bigint").alias("n")))).alias("ls"))
    start = F.struct(F.lit(-1).cast("bigint").alias("chunk"), F.lit(0).cast("bigint").alias("size"), F.array().cast("array<struct<o:bigint,chunk:bigint>>").alias("out"))

    def add(acc: Column, line: Column) -> Column:
        opens = (acc["chunk"] < 0) | ((acc["size"] > 0) & (acc["size"] + line["n"] > most))
        chunk = F.when(opens, acc["chunk"] + 1).otherwise(acc["chunk"])
        return F.struct(
            chunk.alias("chunk"), F.when(opens, line["n"]).otherwise(acc["size"] + line["n"]).alias("size"),
            F.array_append(acc["out"], F.struct(line["o"].cast("bigint").alias("o"), chunk.alias("chunk"))).alias("out"),
        )

    packed = listed.select("doc_id", F.explode(F.aggregate("ls", start, add, lambda acc: acc["out"])).alias("r"))
    return packed.select("doc_id", F.col("r.o").alias(order), F.col("r.chunk").alias("chunk"))


def padded_batches(items: DataFrame, most_items: int, most_padded, order: tuple[str, ...] = ("duration", "item")) -> DataFrame:
    """Items by duration in batches whose longest member times their number stays within a cost (G6). A first item may exceed it."""
    listed = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("ls"))
    kind = dict(items.dtypes)
    start = F.struct(F.lit(0).cast("bigint").alias("batch"), F.lit(0).cast("bigint").alias("n"), F.array().cast(f"array<struct<item:{kind[order[1]]},batch:bigint>>").alias("out"))

    def add(acc: Column, item: Column) -> Column:
        # items come by duration, so the newest is the longest
        opens = (acc["n"] > 0) & ((acc["n"] + 1 > most_items) | (item[order[0]] * (acc["n"] + 1) > most_padded))
        batch = acc["batch"] + opens.cast("bigint")
        return F.struct(
            batch.alias("batch"), F.when(opens, F.lit(1).cast("bigint")).otherwise(acc["n"] + 1).alias("n"),
            F.array_append(acc["out"], F.struct(item[order[1]].alias("item"), batch.alias("batch"))).alias("out"),
        )

    out = listed.select("doc_id", F.explode(F.aggregate("ls", start, add, lambda acc: acc["out"])).alias("r"))
    return out.select("doc_id", F.col("r.item").alias(order[1]), F.col("r.batch").alias("batch"))


def split_long(lines: DataFrame, most: int = 70, order: str = "line") -> DataFrame:
    """Lines of more than `most` words cut (G3): after the last word in the second half that ends with .?!,;: or else at
    `most`. The fold carries the place of the last cut, so that a line's words are held once."""
    least = max(20, most // 2)
    listed = lines.select("doc_id", order, T.tokens(F.col("text")).alias("words"))
    listed = listed.withColumn("stops", F.transform("words", lambda w: w.rlike(r"[.?!,;:]$")))
    rounds = F.expr(f"sequence(0, cast(floor(size(words) / {least + 1}) as int))")  # each round takes more than `least` words
    n = F.size("words")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,n:int>>").alias("cuts"))

    def cut(acc: Column, _: Column) -> Column:
        at, rest = acc["at"], n - acc["at"]
        stop = F.array_max(F.filter(F.sequence(F.lit(least + 1), F.lit(most)), lambda k: F.try_element_at("stops", at + k)))
        size = F.when(rest <= most, rest).otherwise(F.coalesce(stop, F.lit(most)))
        cuts = F.when(rest > 0, F.array_append(acc["cuts"], F.struct(at.alias("a"), size.alias("n")))).otherwise(acc["cuts"])
        return F.struct((at + size).alias("at"), cuts.alias("cuts"))

    out = listed.select("doc_id", order, "words", F.posexplode(F.aggregate(rounds, start, cut, lambda acc: acc["cuts"])).alias("part", "c"))
    return out.select("doc_id", order, F.col("part").cast("bigint").alias("part"), F.array_join(F.slice("words", F.col("c.a") + 1, F.col("c.n")), " ").alias("text"))


def _sentence_pieces(text: str) -> list[str]:
    """A squeezed text cut where sentences end; see sentence_lines."""
    cuts = [0]
    for m in ENDS.finditer(text):
        at = m.start()
        if m[0][0] == ".":
            token = TRAILING.search(text, max(0, at - 64), at + 1)
            between_digits = m.end() == at + 1 and text[at - 1 : at].isdigit() and text[at + 1].isdigit()
            if between_digits or token and token[0].casefold() in T.LINE_ABBREVIATIONS or SITE.search(text[max(0, at - 18) : at + 12]):
                continue
        cuts.append(m.end())
    return [piece for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True) if (piece := text[a:b].strip())]


ENDS = re.compile(r"(?:\.(?!\.)|[?!])\s*(?=[\"'(\[{A-Z0-9])")
TRAILING = re.compile(r"[A-Za-z.]+\Z")
SITE = re.compile(r"\.(?:com|org|net|io|ai|co|tv)\b", re.I)


@F.pandas_udf(ArrayType(StringType()))
def _pieces(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _sentence_pieces(t or ""))


def sentence_lines(docs: DataFrame, most: int = 70, text_col: str = "text") -> DataFrame:
    """(doc_id, line, text): a text cut into sentences (F9), long ones again.

    A sentence ends with . ? or ! before a quote, bracket, capital or digit, with or without white space between.
    Points of abbreviations, inside numbers, and near the names of web sites don't count.
    """
    pieces = docs.select("doc_id", F.posexplode(_pieces(T.squeezed(F.col(text_col)))).alias("line", "text"))
    parts = split_long(pieces, most)
    order = Window.partitionBy("doc_id").orderBy("line", "part")
    return parts.select("doc_id", (F.row_number().over(order) - 1).cast("bigint").alias("line"), "text")
