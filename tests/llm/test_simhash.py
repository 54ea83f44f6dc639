import random

import numpy as np
import pytest
import xxhash
from wordloom.llm import simhash
from wordloom.llm.components import components


def plain(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(nodes, links):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", None, " \n", "a", "A b", "É A B c", "x y z", "x y z x y z", "one two\x1cthree four\x0bfive", "w " * 40000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def brute(fps):
    return [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3]


def clustered(rng, n):
    base = [rng.getrandbits(64) for _ in range(n // 3)]
    out = set(base)
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
        if rng.random() < 0.2:
            base.append(x)
    return [x - 2**64 if x >= 2**63 else x for x in out]


@pytest.mark.parametrize("leaf", [8, 64, 4096])
def test_links(spark, monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF_ROWS", leaf)
    fps = clustered(random.Random(leaf), 1500)
    got = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp bigint"), len(fps)).collect()
    want = brute(fps)
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") for r in got)
    assert roots(fps, [(r.a, r.b) for r in got]) == roots(fps, want)


def test_leaf_with_its_own_levels(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_ROWS", 16)
    rng = random.Random(3)
    fps = clustered(rng, 2000)
    rep = fps[0]
    fps += [f for f in {((rep & (2**64 - 1)) ^ (1 << a) ^ (1 << b)) for a in range(20) for b in range(a)} for f in [f - 2**64 if f >= 2**63 else f] if f not in fps]
    links = []
    for which in (0, 1):
        a, b = simhash.leaf_links(np.array(fps, np.int64), np.zeros(len(fps), bool), which)
        links += list(zip(a.tolist(), b.tolist(), strict=True))
    assert roots(fps, links) == roots(fps, brute(fps))


@pytest.mark.parametrize("which", [0, 1])
def test_one_half_is_hot(spark, monkeypatch, which):
    """Very many fingerprints that agree in one half are dealt out by the other."""
    monkeypatch.setattr(simhash, "LEAF_ROWS", 32)
    rng, same = random.Random(5), 0xDEADBEEF
    fps = {f if f < 2**63 else f - 2**64 for f in (rng.getrandbits(32) << 32 * (1 - which) | (same ^ (1 << rng.randrange(32) if i % 3 == 0 else 0)) << 32 * which for i in range(1500))}
    fps |= {((f & (2**64 - 1)) ^ (1 << 32 * (1 - which) + rng.randrange(31))) - (2**64 if f < 0 else 0) for f in list(fps)[:500]}
    fps = [f - 2**64 if f >= 2**63 else f for f in fps]
    split = []
    monkeypatch.setattr(simhash, "join_counted", lambda left, right, *a, f=simhash.join_counted, **k: split.append(1) or f(left, right, *a, **k))
    got = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp bigint"), len(fps)).collect()
    assert split
    assert roots(fps, [(r.a, r.b) for r in got]) == roots(fps, brute(fps))


def test_drawn_levels(monkeypatch):
    """More levels than are fitted: two points within the radius still meet in a leaf."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, 400, dtype=np.uint32)
    b = a ^ (np.uint32(1) << rng.integers(0, 32, 400).astype(np.uint32))
    tree = simhash.fit_tree(a, 3, 1)
    row, leaf, visits = simhash.route(np.concatenate([a, b]), tree, 1, depth=9)
    homes = {r: x for r, x, v in zip(row.tolist(), leaf.tolist(), visits.tolist(), strict=True) if not v}
    seen = {(r, x) for r, x in zip(row.tolist(), leaf.tolist(), strict=True)}
    assert len(set(homes.values())) > 100
    assert all((i, homes[i + 400]) in seen or (i + 400, homes[i]) in seen for i in range(400))


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b c d", "x", 1), (1, "a b c d", "y", 2), (2, "A b c d", "z", 3), (None, "", "n", 4), (None, None, "m", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept_id string, kept_nth int")
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "None"]
    assert simhash.drop_near_copies(docs.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1001 + i) for i in range(300)]
    some = [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(180)]
    links = path + hub + some
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == roots(nodes, links)


def test_operator(spark):
    base = " ".join(f"word{i}" for i in range(400))
    texts = [base, base.upper(), base + " more", "quite another text of its own here", None, "", " ", "a", base.replace("word7 ", "wrd7 ")]
    docs = spark.createDataFrame([(10 - i, t, "x") for i, t in enumerate(texts)] + [(None, base, "x"), (10, base, "x")], "doc_id bigint, text string, fp string")
    got = simhash.near_dedup(docs).collect()
    assert len(got) == len(texts) + 2
    fps = {r.doc_id: int(r.fingerprint, 16) for r in got}
    for i, t in enumerate(texts):
        assert fps[10 - i] == plain(t)
    links = [(a, b) for a in fps for b in fps if a is not None and b is not None and bin(fps[a] ^ fps[b]).count("1") <= 3]
    want = roots([x for x in fps if x is not None], links)
    for r in got:
        assert r.component_id == (want[10] if r.doc_id is None else want[r.doc_id])
    assert simhash.near_dedup(docs.limit(0)).collect() == []
