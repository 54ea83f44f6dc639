import random
import zlib

import numpy as np
from wordloom.llm import quality


def plain_features(text):
    raw = (text or "").encode()
    return [{raw[i : i + n] for i in range(len(raw) - n + 1)} for n in quality.GRAMS]


def test_features_stand_for_distinct_grams():
    for text in ("", None, "a", "ab", "abcabc", "né | x"):
        got, want = quality.features(text), plain_features(text)
        hashes = {
            ((int.from_bytes(g, "big") + (n << 24)) * 0x9E3779B1 % 2**32) >> (32 - quality.BITS) for n, grams in zip(quality.GRAMS, want, strict=True) for g in grams
        }
        assert hashes <= set(got.tolist())
        assert len(got) <= len(hashes) + 4
        assert (np.diff(got.astype(int)) > 0).all()


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("ab é\n") for _ in range(5000))
    whole = quality.features(text)
    monkeypatch.setattr(quality, "BLOCK", 100)
    assert np.array_equal(whole, quality.features(text))


def test_descent_reaches_the_optimum():
    """Against subgradient conditions of the dual, spelled out."""
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(40, 6, replace=False)).astype(np.uint32) for _ in range(60)]
    good = rng.random(60) < 0.5
    values = [np.ones(6) / 6**0.5 for _ in rows]
    quality_rounds, quality.ROUNDS = quality.ROUNDS, 2000
    weights, bias = quality.dual_coordinate_descent(values, rows, good)
    quality.ROUNDS = quality_rounds
    x = np.zeros((60, 41))
    for i, r in enumerate(rows):
        x[i, r] = values[i]
        x[i, 40] = 1
    sign = np.where(good, 1, -1)
    n1, n0 = good.sum(), (~good).sum()
    cost = np.where(good, max(1, n0 / n1), max(1, n1 / n0))
    w = np.append(weights[:40], bias)

    def primal(w):
        return w @ w / 2 + (cost * np.maximum(0, 1 - sign * (x @ w))).sum()

    best = primal(w)
    for _ in range(300):
        assert primal(w + rng.normal(0, 0.02, 41)) >= best - 1e-3


def corpus(rng, n):
    words = ["river", "stone", "under", "table", "quiet", "seven", "walked", "paper"]
    out = []
    for i in range(n):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(words) + ("" if good else rng.choice(["$$$", "###"])) for _ in range(rng.randrange(3, 60)))
        out.append((i, text, int(good)))
    return out


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(random.Random(4), 400)
    docs = spark.createDataFrame([(i, t, i) for i, t, _ in rows] + [(None, "river stone", 0), (9000, None, 0), (9001, "", 0), (3, rows[3][1], 0)], "doc_id bigint, text string, quality int")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(1, None, 0), (None, 1, 0), (77777, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit_on_documents(docs, labels)
    got = quality.score_documents(docs, model).collect()
    assert len(got) == 404
    want = {i: q for i, _, q in rows}
    out = [r for r in got if r.held_out and r.doc_id in want]
    assert len(out) > 50 and sum(r.predicted == want[r.doc_id] for r in out) > 0.97 * len(out)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    kept = quality.drop_poor(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.score_documents(docs.limit(0), model).count() == 0


def test_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    for labels, least, most in (([], 0.5, 0.5), ([(1, 1), (2, 1)], 0.5, 1), ([(1, 0), (2, 0)], 0, 0.5)):
        model = quality.fit_on_documents(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
        for r in quality.score_documents(docs, model).collect():
            assert least <= r.score <= most
