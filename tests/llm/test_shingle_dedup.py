import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
import numpy as np
from wordloom.llm import shingle_dedup

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def alike(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    return [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]


def test_components(spark):
    rng = random.Random(2)
    texts = {}
    for i in range(40):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 12, 120, 600]))]
        for k in range(6):
            texts[10 * i + k] = " ".join(words)
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(500)}"
    texts |= {900: None, 901: "", 902: " ", 903: "A b", 904: "a  B"}
    docs = spark.createDataFrame(list(texts.items()) + [(903, "A b")], "doc_id bigint, text string")
    root, pairs, before = {i: i for i in texts}, alike(texts), None
    while root != before:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = shingle_dedup.shingle_components(docs).collect()
    assert len(got) == len(texts) + 1 and {r.doc_id: r.component_id for r in got} == root
    assert len(set(root.values())) < len(root) - 40
    assert shingle_dedup.shingle_components(docs.limit(0)).collect() == []


def test_pipeline_leaves_no_near_copies(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[:3])
    left = corpus_pipeline.run(spark, SF)
    assert left.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
    assert alike({r.doc_id: r.text for r in left.collect()}) == []


def test_further_pairs(spark, monkeypatch):
    """A band with more nodes than a tile: all pairs of components with like signatures, and few others."""
    monkeypatch.setattr(shingle_dedup, "TILE", 8)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, (20, 96)).astype(np.uint16)
    rows, sketches = [], {}
    for node in range(60):
        own = base[node % 20].copy()
        own[rng.choice(96, 10, replace=False)] = 7
        sketches[node] = own
        rows += [(key, node, node if node % 2 else 1000, own.tobytes()) for key in (5, 6)]
    root = {node: r for _, node, r, _ in rows}
    got = {(r.a, r.b) for r in shingle_dedup.further_pairs(spark.createDataFrame(rows, "key bigint, node bigint, root bigint, sketch binary"), 4).collect()}
    want = {(a, b) for a in sketches for b in sketches if a > b and root[a] != root[b] and (sketches[a] == sketches[b]).sum() >= 0.6 * 96}
    assert got == want and len(want) > 15


def test_links_of_a_large_group(spark, monkeypatch):
    """Copies changed again and again, of which many are alike and more nearly so: what leaves the tiles connects what is
    alike, and grows with the nodes, not with the pairs."""
    monkeypatch.setattr(shingle_dedup, "TILE", 64)
    rng = np.random.default_rng(4)
    base, sets = rng.integers(0, 1 << 63, 150).astype(np.uint64), {}
    for node in range(300):
        own = base.copy()
        own[rng.choice(150, rng.integers(5, 45), replace=False)] = rng.integers(0, 1 << 63)
        sets[node] = np.unique(own)
    rows = [(key, node, 0 if node < 100 else node, shingle_dedup.bands(s)[1], s.tobytes()) for node, s in sets.items() for key in (5, 6)]
    placed = spark.createDataFrame(rows, "key bigint, node bigint, root bigint, sketch binary, shingles binary")
    got = [(r.a, r.b) for r in shingle_dedup.further_pairs(placed, 4, 0.8).collect()]
    same = {(a, b) for a in sets for b in sets if a > b and shingle_dedup.similarity(sets[a], sets[b]) >= 0.8}
    assert set(got) <= same and len(same) > 10 * len(got) and len(got) < 5 * len(sets)

    def reached(links):
        root = {n: 0 if n < 100 else n for n in sets}
        for _ in sets:
            before = dict(root)
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
            if root == before:
                return root

    assert reached(got) == reached(same) and len(set(reached(got).values())) > 1
