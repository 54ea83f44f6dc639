"""Exact dedup against a dictionary."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from wordloom.llm import exact_dedup as E

SCHEMA = "doc_id bigint, text string, lang string, kept_sha string, kept_nth string"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, pick):
    groups = {}
    for i, text in rows:
        groups.setdefault(low(text), []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = pick(known) if known else None
        kept = set()
        for i in ids:
            first = i == best and best not in kept
            kept |= {i} if first else set()
            out.append((i, best, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_against_dictionary(spark, monkeypatch, keep):
    monkeypatch.setattr(E, "NODE_ROWS", 16)  # many rounds
    rng = random.Random(3)
    rows = [(rng.choice([i, i, None]), rng.choice([None, "", "A b", "a B", "É", "é", f"t{rng.randrange(40)}", "hot"])) for i in range(600)]
    rows += [(5, "x" * 1_000_000), (6, "X" * 1_000_000), (6, "x" * 1_000_000), (7, "same"), (7, "same"), (None, "lone"), (None, "lone")]
    docs = spark.createDataFrame([(i, t, "l", "a", "b") for i, t in rows], SCHEMA).repartition(7)
    got = sorted((tuple(r) for r in E.exact_dedup(docs, keep=keep).collect()), key=repr)
    assert got == plain(rows, min if keep == "min" else max)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert E.exact_dedup(docs).collect() == []
    assert E.drop_copies(docs).collect() == []


def test_one_text_very_often(spark):
    docs = spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Once").otherwise("once").alias("text"))
    found = E.exact_dedup(docs, keep="max")
    assert found.agg(F.min("keep_id"), F.max("keep_id"), F.min("group_size"), F.count_if("kept")).first() == (999_999, 999_999, 1_000_000, 1)


def test_runs_are_sorted_and_merged(spark):
    """Each round's exchange is followed by a sort and the merge; nothing is left to a hash table."""
    digests = E.digest_table(spark.range(50).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))
    plan = E.merge_runs(digests, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    assert plan.count("MapInArrow") == 3 and plan.count("Sort [node") == 2, plan


def test_merge_verifies_digests():
    a = [(b"d", 1, 1, 4, 2), (b"d", 2, 1, 3, 1), (b"e", 1, 1, None, 1)]
    b = [(b"d", 1, 1, 2, 1), (b"d", 1, 9, 1, 1), (b"e", 1, 1, 8, 1)]
    assert list(E.merge_sorted([iter(a), iter(b)])) == [(b"d", 1, 1, 2, 3), (b"d", 1, 9, 1, 1), (b"d", 2, 1, 3, 1), (b"e", 1, 1, 8, 2)]


def test_drop_copies_leaves_columns_alone(spark):
    rows = [(1, "A", "x", "sha", "nth"), (2, "a", "y", None, "n"), (2, "a", "z", "s", None), (3, None, "q", "s", "t"), (4, "", "w", "k", "l"), (None, "lone", "v", "", "")]
    out = E.drop_copies(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "lang", "kept_sha", "kept_nth"]
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= set(rows) and sorted(map(str, (r[0] for r in got))) == ["2", "4", "None"]
