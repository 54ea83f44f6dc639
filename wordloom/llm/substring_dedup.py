"""Substring dedup by lines and their sentences: units are normalised and grouped by digest, and the earliest stays."""

from __future__ import annotations

import hashlib
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import table, tidy
from wordloom.llm.suffix_dedup import ORD_BITS, keyed_documents, runs, within

#: Words of a unit in op6_line_dedup, line or sentence: about the 100 bytes that make a repeat in op4_suffix_dedup. Shorter
#: ones repeat by chance, in documents that have nothing else in common; those that follow each other are units together.
UNIT_WORDS = 16

LINE = re.compile(r"[^\n]+")
SENTENCE = re.compile(r"\S.*?(?:(?<![.!?])[.!?]++(?=\s)|[。！？]++|$)", re.S)
#: Letters of scripts that set no blanks between words: two of the first, or four of the second, count as a word.
PAIRED, FOURFOLD = re.compile(r"[぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]"), re.compile(r"[฀-໿က-႟ក-៿]")


def size(body: str) -> int:
    """Words of a text."""
    n = len(body.split())
    return n if body.isascii() else max(n, len(PAIRED.findall(body)) // 2 + len(FOURFOLD.findall(body)) // 4)


def stretches(short: list[tuple[int, int, str, int]], least: int) -> list[tuple[int, int, str]]:
    """Units of short parts (start, stop, normalised, size) that follow each other: from each the fewest after it, and
    to each the fewest before it, that have `least` words. They cover every repeat of as many words in whole parts.

    One that overlaps an earlier one of the same words is none: the first would lose its end.
    """
    found, total = set(), [0]
    for part in short:
        total.append(total[-1] + part[3])
    stop = 1
    for i in range(len(short)):
        while stop <= len(short) and total[stop] - total[i] < least:
            stop += 1
        if stop > len(short):
            break
        found.add((i, stop))
    start = 0
    for j in range(1, len(short) + 1):
        while total[j] - total[start + 1 if start < j else start] >= least:
            start += 1
        if total[j] - total[start] >= least:
            found.add((start, j))
    out, ends = [], {}
    for i, j in sorted(found):
        unit = " ".join(part[2] for part in short[i:j])
        if ends.get(unit, 0) <= i:
            ends[unit] = j
            out.append((short[i][0], short[j - 1][1], unit))
    return out


def units(text: str, line_words: int = 1, sentence_words: int | None = None) -> list[tuple[int, int, str]]:
    """(start, stop, normalised) of the units, in code points, by start and then the longer first.

    Normalised is lower-cased with single blanks. A line of `line_words` or more is a unit; so are, unless
    `sentence_words` is None, its sentences of as many words or more if it has several. Shorter lines, and shorter
    sentences of a line, are units in stretches of those that follow each other.
    """
    out, lines = [], []
    for line in LINE.finditer(text):
        body = line[0].strip()
        if not body:
            continue
        at = line.start() + line[0].index(body[0])
        n, own = size(body), " ".join(body.lower().split())
        if n < line_words:
            lines.append((at, at + len(body), own, n))
            continue
        out += stretches(lines, line_words)
        lines = []
        out.append((at, at + len(body), own))
        sentences = list(SENTENCE.finditer(body)) if sentence_words is not None and n > sentence_words else []
        if len(sentences) > 1:
            short = []
            for s in sentences:
                sentence = s[0].rstrip()
                part = (at + s.start(), at + s.start() + len(sentence), " ".join(sentence.lower().split()), size(sentence))
                if part[3] < sentence_words:
                    short.append(part)
                    continue
                out += [*stretches(short, sentence_words), part[:3]]
                short = []
            out += stretches(short, sentence_words)
    out += stretches(lines, line_words)
    # a stretch can be all of a line: as a unit of its own it would be a later copy of that line, in the same place
    return sorted({u[:2]: u for u in out}.values(), key=lambda u: (u[0], -u[1]))


def _unit_digests(batches, line_words: int, sentence_words: int | None):
    for batch in batches:
        places, digests = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for k, (_, _, unit) in enumerate(units(text.as_py() or "", line_words, sentence_words)):
                places.append(within(key, k))
                digests.append(hashlib.blake2b(unit.encode(), digest_size=16).digest())
        h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(places, pa.int64())], names=["h1", "h2", "place"])


def _kept(batches, line_words: int, sentence_words: int | None):
    for batch in batches:
        out = ([], [], [], [], [], [])
        for doc_id, text, firsts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            text, first = text.as_py() or "", set(firsts or [])
            gone, own = np.zeros(len(text), bool), units(text, line_words, sentence_words)
            for k, (a, b, _) in enumerate(own):
                if k not in first:
                    gone[a:b] = True
            keep = [(int(a), int(b)) for a, b in runs(~gone)]
            values = (doc_id, len(own), len(own) - len(first), [{"start": int(a), "stop": int(b)} for a, b in runs(gone)], [{"start": a, "stop": b} for a, b in keep], "".join(text[a:b] for a, b in keep))
            for column, value in zip(out, values, strict=True):
                column.append(value)
        spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), spans, spans, pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "n_units", "n_removed", "removed", "kept", "text"])


def substring_dedup(docs: DataFrame, line_words: int = 1, sentence_words: int | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_units, n_removed (units), removed and kept (start, stop in code points of the
    text as it was), and the text that is left.

    Of units that are alike once normalised, the earliest stays: that of the smallest doc_id, then of the smallest
    offset. All others go, wherever they are. The grouping keeps one row per kind of unit before the shuffle already,
    and a document learns which of its units are firsts, so a line that very many documents share is no hot key. Of
    rows that repeat an id, the text's hash orders them; null ids come first; a null text is empty; an empty table gives
    none. Other columns are ignored.

    By default every line that isn't blank is a unit, and lines only: repeats within a line stay. With least words
    (see units) short lines that repeat by chance stay, and so does what is left of a repeat beside its whole units.
    """
    sizes = {"line_words": line_words, "sentence_words": sentence_words}
    texts = keyed_documents(docs)
    digests = texts.select("key", "text").mapInArrow(partial(_unit_digests, **sizes), "h1 bigint, h2 bigint, place bigint")
    firsts = digests.groupBy("h1", "h2").agg(F.min("place").alias("place")).select(
        F.shiftright("place", ORD_BITS).alias("key"), F.col("place").bitwiseAND(F.lit((1 << ORD_BITS) - 1)).cast("int").alias("unit")
    )
    firsts = tidy(firsts.groupBy("key").agg(F.collect_list("unit").alias("firsts")))
    span = "array<struct<start:bigint,stop:bigint>>"
    return texts.join(firsts, "key", "left").select("doc_id", "text", "firsts").mapInArrow(
        partial(_kept, **sizes), f"doc_id bigint, n_units bigint, n_removed bigint, removed {span}, kept {span}, text string"
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"), UNIT_WORDS, UNIT_WORDS)
    removed = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
    return found.select("doc_id", "n_units", "n_removed", removed.alias("removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
