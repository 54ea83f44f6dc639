import random

import numpy as np
import pytest
from wordloom.llm import ann


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(v, np.float32).astype(float))
    out = []
    for q in sorted(good):
        if q % 20 == 0:
            scored = []
            for c, v in good.items():
                if c != q and len(v) == len(good[q]):
                    total = 0.0
                    for a, b in zip(good[q], v, strict=True):
                        total += a * b
                    scored.append((-total, c))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("shape", [(ann.QUERY_ROWS, ann.STRIP_ROWS, 256, 2048), (4, 16, 3, 5), (8, 1000, 3, 25)])
def test_against_brute_force(spark, monkeypatch, shape):
    for name, value in zip(("QUERY_ROWS", "STRIP_ROWS", "TILE_QUERIES", "TILE_CANDIDATES"), shape, strict=True):
        monkeypatch.setattr(ann, name, value)
    monkeypatch.setattr(ann, "PAIRS", 7)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) * (1 if i % 7 else 1e-4) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, list(rows[5][1])) for i in range(90)]  # ties
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [1.0, None] * 4), (2060, [float("nan")] + [1.0] * 7), (2080, [float("inf")] * 8), (2100, [1.0, 2.0]), (2101, [3.0, 1.0]), (2120, [3.0] * 9)]
    rows += [(20, rows[20][1]), (None, [1.0] * 8), (-40, [2.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, query_id int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, "id % 20 = 0").collect())
    assert got == brute(rows, 20)


def test_empty(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), "id % 20 = 0").collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, (50, 64)) * 10.0 ** rng.integers(-20, 20, (50, 1)), rng.normal(0, 1, (60, 64)) ** 5
    left, right = ann.Tile(a), ann.Tile(b)
    product, off = left.bounds(right, slice(0, 50), slice(0, 60))
    assert (np.abs(a @ b.T - product) <= off).all()
    assert np.median(off / np.abs(a @ b.T)) < 1


def test_repeated_ids_with_different_vectors(spark):
    """The least vector of an id counts, as query and as candidate, wherever its rows are."""
    rows = [(20, [1.0, 0.0]), (20, [0.5, 9.0]), (1, [2.0, 0.0]), (1, [2.0, -1.0]), (2, [1.0, 1.0])]
    want = brute([(20, [0.5, 9.0]), (1, [2.0, -1.0]), (2, [1.0, 1.0])], 20)
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "vec_id bigint, embedding array<float>").repartition(5)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, "id % 20 = 0").collect()) == want


def test_doubles_stay_doubles(spark):
    rows = [(0, [1 / 3, 1e-3]), (1, [1 / 7, 5.0]), (2, [1 / 9, 2.0])]
    got = {r.vec_id: r.score for r in ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "id = 0").collect()}
    assert got == {1: 1 / 3 * (1 / 7) + 1e-3 * 5.0, 2: 1 / 3 * (1 / 9) + 1e-3 * 2.0}
