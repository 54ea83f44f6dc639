"""Quality of transcripts: repetition and rate gates, word error rate, boundary errors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from wordloom.functions import text as T
from wordloom.operators.anchors import fresh

GRAM = 4
REPEAT_SIZES = (3, 4, 5, 6)


COUNTS = StructType([StructField(c, StringType() if c == "gram" else LongType()) for c in ("n", "distinct", "repeats", "gram", "top")])


def _counts(tokens: list[str]) -> tuple[int, int, int | None, str | None, int | None]:
    """Words, different words, longest run of an n-gram that follows itself at once (n of REPEAT_SIZES), and the most
    frequent GRAM-gram, the one that came first of equals, with its count; null where there is no n-gram."""
    codes: dict[str, int] = {}
    t = np.array([codes.setdefault(w, len(codes)) for w in tokens], np.int64)
    repeats = None
    for n in REPEAT_SIZES:
        if len(t) >= n:
            # a gram that is followed by itself k times is a stretch of n * k words that equal the ones n further on
            same = np.concatenate(([0], t[:-n] == t[n:], [0])).astype(np.int8)
            edges = np.flatnonzero(np.diff(same))
            longest = int((edges[1::2] - edges[::2]).max(initial=0))
            repeats = max(repeats or 1, 1 + longest // n)
    if len(t) < GRAM:
        return len(t), len(codes), repeats, None, None
    seen: dict[tuple, int] = {}
    for gram in zip(*(tokens[k:] for k in range(GRAM)), strict=False):
        seen[gram] = seen.get(gram, 0) + 1
    top = max(seen, key=seen.__getitem__)  # of equals the first that was put in
    return len(t), len(codes), repeats, " ".join(top), seen[top]


@F.pandas_udf(COUNTS)
def _gate_counts(tokens: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_counts([] if t is None else list(t)) for t in tokens], columns=COUNTS.names).astype({"n": "Int64", "distinct": "Int64", "repeats": "Int64", "top": "Int64"})


def gate_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n, distinct, repeats, gram and top of the words that the gate counts (F5, A8, A9, A10, L2): a document is
    counted where it is, nothing is shuffled."""
    return docs.withColumn("_c", _gate_counts(T.quality_tokens(F.col(text_col)))).select("*", "_c.*").drop("_c")


def dominant_gram(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, gram, count): the most frequent 4-gram, the one that came first of equals."""
    return gate_counts(docs.select("doc_id", text_col), text_col).filter("gram is not null").select("doc_id", "gram", F.col("top").alias("count"))


def consecutive_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, repeats): the longest run of a 3- to 6-gram that follows itself at once (A10)."""
    return gate_counts(docs.select("doc_id", text_col), text_col).filter("repeats is not null").select("doc_id", "repeats")


def transcript_quality(docs: DataFrame, duration: Column | None = None) -> DataFrame:
    """The gate (P4, A8): counts, shares, reasons against a transcript, and ok if there are none."""
    limit = F.lit(None).cast("double") if duration is None else duration.cast("double")
    out = gate_counts(docs.select("doc_id", "text", limit.alias("duration")))
    out = out.withColumns({"repeats": F.coalesce("repeats", F.lit(1)), "top": F.coalesce("top", F.lit(0))})
    unique = F.col("distinct") / F.greatest("n", F.lit(1))
    reasons = (
        ("too_few_words", F.col("n") < 3),
        ("consecutive_ngram_loop", (F.col("n") >= 40) & ((F.col("repeats") >= 8) | ((F.col("repeats") >= 4) & (unique < 0.08)))),
        ("dominant_ngram_loop", (F.col("n") >= 80) & (F.col("top") >= F.greatest(F.lit(12), F.floor(F.col("n") * 2 / 100)))),
        ("low_vocabulary", (F.col("n") >= 100) & (unique < 0.08)),
        ("implausibly_fast", F.coalesce((F.col("duration") > 0) & (F.col("n") / F.col("duration") > 5.5), F.lit(False))),
    )
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in reasons]))
    return out.select("doc_id", F.col("n").alias("word_count"), unique.alias("unique_ratio"), F.col("repeats").alias("max_repeats"), F.col("top").alias("top_count"), found.alias("reasons"), (F.size(found) == 0).alias("ok"))


def accept_short(reasons: Column, text: Column, duration: Column) -> Column:
    """Windows let through although they fail (P5): short ones with too few words only, very short blank ones."""
    blank = F.size(T.tokens(text)) == 0
    few = (F.size(reasons) == 1) & F.array_contains(reasons, "too_few_words")
    return F.when(blank, few & (duration <= 2.5)).otherwise(few & (duration <= 10))


def quarantine(reasons: Column, duration: Column, longest: float, allowed: tuple[str, ...]) -> Column:
    """May a failed window be emptied and passed (P6)?"""
    return (F.size(reasons) > 0) & (duration <= longest) & (F.size(F.array_except(reasons, F.array(*[F.lit(a) for a in allowed]))) == 0)


def coverage(words: DataFrame, prefix: str = "mfa_") -> DataFrame:
    """(doc_id, words, effective, rate): words whose source has the prefix (A2, P10 with a warning under 0.9)."""
    per = words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("source").startswith(prefix)).alias("effective"))
    rate = F.col("effective") / F.greatest("words", F.lit(1))
    return per.withColumns({"rate": rate, "warning": F.when(rate < 0.9, "low_coverage")})


def source_counts(words: DataFrame) -> DataFrame:
    """(A1)"""
    return words.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("words"))


# ---- word error rate ----


def edit_distance(a: list, b: list) -> int:
    """Edits between two token lists: a column of costs is held as the bits of two whole numbers, of its rises and its
    falls, so that a token costs a few operations on numbers of as many bits as the longer list has tokens."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict = {}
    for i, token in enumerate(a):
        places.setdefault(token, []).append(i)
    bits = _bits(places, set(b))
    full, last, up, down, cost = (1 << len(a)) - 1, 1 << (len(a) - 1), (1 << len(a)) - 1, 0, len(a)
    for token in b:
        same = bits.get(token, 0)
        level = same | down
        across = (((same & up) + up) ^ up) | same
        rises, falls = down | (full & ~(across | up)), up & across
        cost += bool(rises & last) - bool(falls & last)
        rises, falls = (rises << 1 | 1) & full, (falls << 1) & full
        up, down = falls | (full & ~(level | rises)), rises & level
    return cost


def _bits(places: dict, wanted: set) -> dict:
    out = {}
    for token, own in places.items():
        if token in wanted and len(own) == 1:
            out[token] = 1 << own[0]
        elif token in wanted:
            raw = bytearray(own[-1] // 8 + 1)
            for i in own:
                raw[i >> 3] |= 1 << (i & 7)
            out[token] = int.from_bytes(raw, "little")
    return out


@F.pandas_udf(LongType())
def _distances(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else edit_distance(list(a), list(b)) for a, b in zip(left, right, strict=True)], dtype="Int64")


def word_distance(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with `distance`, the edits between two token arrays (A11), of any length and any number of different tokens."""
    return pairs.withColumn("distance", _distances(F.col(left), F.col(right)))


#: A cost table of at most about so many bytes is held whole. Of a larger one a column in KEPT_COLUMNS is kept; those between are
#: computed again for the path.
HELD_BYTES, KEPT_COLUMNS = 1 << 26, 256


def _columns(places: dict, n: int, gold: list, state: tuple[int, int]) -> tuple[list[tuple[int, int]], tuple[int, int]]:
    """The columns of the cost table for the tokens of `gold`, from the state before them, and the state after them. Of a
    column two numbers of n bits: where a cost equals the one before it on the diagonal, and where costs rise down it."""
    full, (up, down), out = (1 << n) - 1, state, []
    for token in gold:
        same = places.get(token, 0)
        level = ((((same & up) + up) ^ up) | same | down) & full
        rises = (down | (level | up) ^ full) << 1 | 1
        up = ((level & up) << 1 | ~(level | rises)) & full
        down = rises & level
        out.append((level, up))
    return out, (up, down)


def _alignment(predicted: list[str], gold: list[str]) -> tuple[int, list[tuple[int, int]]]:
    """Edit distance and the pairs of equal tokens on one best path: kept on the diagonal where tokens are equal, and of
    equal costs a substitution before a deletion before an insertion.

    The table is held as the bits of whole numbers (see edit_distance), whole or one column in KEPT_COLUMNS.
    """
    n, m = len(predicted), len(gold)
    if not n or not m:
        return n + m, []
    seen: dict = {}
    for i, token in enumerate(predicted):
        seen.setdefault(token, []).append(i)
    places, wide = _bits(seen, set(gold)), m if (n // 3 + 128) * m <= HELD_BYTES else KEPT_COLUMNS
    kept, state = [], ((1 << n) - 1, 0)
    for begin in range(0, m, wide):
        kept.append(state)
        held, state = _columns(places, n, gold[begin : begin + wide], state)
    i, j, pairs, edits, block = n, m, [], 0, (m - 1) // wide
    while i and j:
        i, j = i - 1, j - 1
        if predicted[i] == gold[j]:
            pairs.append((i, j))
            continue
        edits += 1
        if j // wide != block:
            block = j // wide
            held, _ = _columns(places, n, gold[block * wide : j + 1], kept[block])
        level, up = held[j - block * wide]
        if level >> i & 1:  # not a substitution
            if up >> i & 1:
                j += 1
            else:
                i += 1
    return edits + i + j, pairs[::-1]


ALIGNED = StructType([StructField("distance", LongType()), StructField("a", ArrayType(IntegerType())), StructField("b", ArrayType(IntegerType())), StructField("empty", BooleanType())])


def _aligned_lists(predicted: pa.Array, gold: pa.Array, form) -> pa.Array:
    """For two columns of word lists, compared by `form`: distance and pairs of _alignment, and if any word is empty then.
    Different words of a batch get their form once; what is aligned are numbers."""
    words = pa.concat_arrays([predicted.flatten(), gold.flatten()]).dictionary_encode()
    numbers: dict[str, int] = {"": 0}
    own = np.array([numbers.setdefault(form(w), len(numbers)) for w in words.dictionary.to_pylist()], np.int64)
    codes = own[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
    sizes = np.concatenate([pc.list_value_length(side).to_numpy(zero_copy_only=False) for side in (predicted, gold)])
    ends, n = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), len(predicted)
    distances, empty, left, right = [], [], [], []
    for k in range(n):
        both = [codes[ends[i] : ends[i + 1]] for i in (k, n + k)]
        distance, pairs = _alignment(*(x.tolist() for x in both))
        distances.append(distance)
        empty.append(not all(x.all() for x in both))
        found = np.array(pairs, np.int32).reshape(-1, 2)
        left.append(found[:, 0])
        right.append(found[:, 1])
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in left]))), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *side]))) for side in (left, right)]
    return pa.StructArray.from_arrays([pa.array(distances, pa.int64()), *lists, pa.array(empty, pa.bool_())], names=["distance", "a", "b", "empty"])


@F.arrow_udf(ALIGNED)
def _aligned(predicted: pa.Array, gold: pa.Array) -> pa.Array:
    return _aligned_lists(predicted, gold, str)


@F.arrow_udf(ALIGNED)
def _aligned_normal(predicted: pa.Array, gold: pa.Array) -> pa.Array:
    return _aligned_lists(predicted, gold, T.normal_form)


def _at(words: str, place: Column, field: str) -> Column:
    """A field of one of an array of words. The word comes first: an array of the field would be made for every place anew."""
    return F.get(F.col(words), place)[field]


def align_words(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, predicted_index, gold_index) of equal words on the best alignment (J3) of (doc_id, index, token)."""
    found = alignments(predicted, gold).select("doc_id", F.explode("pairs").alias("p"))
    return found.select("doc_id", F.col("p.a").alias("predicted_index"), F.col("p.b").alias("gold_index"))


def alignments(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, distance, pairs) of every document that has words on both sides: edits, and the equal words on the best
    alignment as structs of both indexes (J3, A11). Tokens are gathered on the JVM; a batch of documents is aligned at once."""

    def listed(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("index", F.coalesce("token", F.lit("")).alias("token")))).alias(name))

    both = listed(fresh(predicted, "doc_id", "index", "token"), "l").join(listed(fresh(gold, "doc_id", "index", "token"), "r"), "doc_id")
    found = both.withColumn("x", _aligned(F.col("l.token"), F.col("r.token")))
    pairs = F.transform(F.arrays_zip("x.a", "x.b"), lambda p: F.struct(_at("l", p["a"], "index").alias("a"), _at("r", p["b"], "index").alias("b")))
    return found.select("doc_id", "x.distance", pairs.alias("pairs"))


def boundary_errors(pairs: DataFrame, predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, error): two per matched word, of its start and its end."""
    p = predicted.select("doc_id", F.col("index").alias("predicted_index"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    g = gold.select("doc_id", F.col("index").alias("gold_index"), F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    both = pairs.join(p, ["doc_id", "predicted_index"]).join(g, ["doc_id", "gold_index"])
    return both.select("doc_id", F.explode(F.array(F.abs(F.col("p_start") - F.col("g_start")), F.abs(F.col("p_end") - F.col("g_end")))).alias("error"))


def median_and_p95(values: DataFrame, column: str) -> DataFrame:
    """Median (A4), p95 by linear interpolation (A5) and p95 by the lower index."""
    low = F.element_at(F.array_sort(F.collect_list(column)), (F.floor(0.95 * (F.count(column) - 1)) + 1).cast("int"))
    return values.groupBy("doc_id").agg(F.count(column).alias("samples"), F.percentile(column, 0.5).alias("median"), F.percentile(column, 0.95).alias("p95"), low.alias("p95_low"))


def quality_report(predicted: DataFrame, gold: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """One row per document (A15, D15): counts, word errors, rate, matched words and boundary errors.

    predicted and gold: (doc_id, index, text, start, end); a `clean` form is preferred if predicted has one. metadata:
    (doc_id, effective_words, coverage), optional. A document needs words on both sides. `problem` names why a document
    can't be judged, a word without letters or digits or a bound of a matched word that isn't finite; its errors and
    rates are null then.
    """
    own = F.coalesce(F.nullif("clean", F.lit("")), "text") if "clean" in predicted.columns else F.col("text")

    def listed(side: DataFrame, word: Column, name: str) -> DataFrame:
        words = side.select("doc_id", "index", F.coalesce(word, F.lit("")).alias("text"), "start", "end")
        return words.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("index", "text", "start", "end"))).alias(name))

    # a document's words meet in one row: nothing is joined word by word. They are normalised there, as Python in between
    # would make Spark forget how its input is dealt out, and move all words again
    both = listed(predicted, own, "l").join(listed(gold, F.col("text"), "r"), "doc_id").withColumn("x", _aligned_normal(F.col("l.text"), F.col("r.text")))

    def apart(p: Column, side: str) -> Column:
        return F.abs(_at("l", p["a"], side) - _at("r", p["b"], side))

    errors = F.sort_array(F.flatten(F.transform(F.arrays_zip("x.a", "x.b"), lambda p: F.array(apart(p, "start"), apart(p, "end")))))
    n_p, n_g = F.size("l").cast("bigint").alias("n_p"), F.size("r").cast("bigint").alias("n_g")
    out = both.select("doc_id", n_p, n_g, "x.distance", F.size("x.a").cast("bigint").alias("matched"), errors.alias("errors"), F.col("x.empty").alias("empty"))
    out = out.join(metadata, "doc_id", "left") if metadata is not None else out.withColumns({"effective_words": F.lit(0), "coverage": F.lit(None).cast("double")})
    unsound = F.exists("errors", lambda e: e.isNull() | F.isnan(e) | (e == F.lit(float("inf"))))
    out = out.withColumn("problem", F.when(F.col("empty"), "empty token").when(unsound, "bound not finite"))

    def judged(value: Column) -> Column:
        return F.when(F.col("problem").isNull(), value)

    def quantile(q: float) -> Column:
        at = (F.size("errors") - 1) * F.lit(q)
        low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
        return F.when(F.size("errors") > 0, F.get("errors", low) + (F.get("errors", high) - F.get("errors", low)) * (at - low))

    effective = F.coalesce("effective_words", F.lit(0))
    return out.select(
        "doc_id", F.col("n_g").alias("reference_word_count"), F.col("n_p").alias("predicted_word_count"), judged(F.col("distance")).alias("word_errors"),
        judged(F.round(F.col("distance") / F.col("n_g"), 6)).alias("wer"), judged(F.col("matched")).alias("timing_matched_words"),
        judged(F.size("errors").cast("bigint")).alias("boundary_sample_count"), judged(F.round(quantile(0.5), 6)).alias("boundary_error_median"), judged(F.round(quantile(0.95), 6)).alias("boundary_error_p95"),
        effective.alias("effective_words"), F.round(effective / F.greatest("n_p", F.lit(1)), 6).alias("application_rate"), F.col("coverage").cast("double").alias("reported_coverage"), "problem",
    )
