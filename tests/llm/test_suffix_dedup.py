import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from wordloom.llm import suffix_dedup as sd


def brute(rows):
    """(n_bytes, n_removed, spans, sha) per row, in order of id (nulls first); every window is looked up."""
    seen, out = set(), {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k)):
        raw = (rows[k][1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        spans = [(a, b) for a in range(len(raw)) if gone[a] and (not a or not gone[a - 1]) for b in [next((x for x in range(a, len(raw)) if not gone[x]), len(raw))]]
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[k] = (rows[k][0], len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return [out[k] for k in range(len(rows))]


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, key string")
    got = [(r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.stop) for s in r.spans], r.kept_sha256) for r in sd.suffix_dedup(docs).collect()]
    return sorted(got, key=str)


def corpus(seed, n=70):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(400)]

    def prose(k):
        return " ".join(rng.choice(words) for _ in range(k))

    passages = [prose(rng.randrange(14, 60)) for _ in range(4)] + ["ab" * 90, "Ber " * 70]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.25 and rows:
            text = rng.choice(rows)[1]
            if rng.random() < 0.6:
                cut = rng.randrange(len(text) + 1)
                text = text[:cut] + rng.choice(["", "X", prose(3)]) + text[cut + rng.randrange(3) :]
        elif kind < 0.7:
            text = prose(rng.randrange(0, 80)) + rng.choice(passages) + prose(rng.randrange(0, 80))
        else:
            text = prose(rng.randrange(0, 900))
        rows.append((i * 7 - 20, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("setting", [{}, {"MOST_CONTEXTS": 6, "SHARD_BYTES": 3000, "BLOCK": 512}])
def test_against_every_window(spark, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(sd, name, value)
    rows = corpus(len(setting))
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_edges(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away, " * 2
    rows = [(3, long), (1, long + "x"), (None, long), (2, None), (4, ""), (5, "z" * 99), (6, "z" * 100), (7, "z" * 101), (3, long), (2**62, "q" * 3000), (-(2**62), "q" * 150)]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert run(spark, []) == []


def test_blocks_change_no_item(monkeypatch):
    rng = random.Random(2)
    raw = bytes(rng.choices(b"abcdef ", k=30_000))
    whole, anchors = sd.items(raw), sd.anchored(raw, sd.open_windows(raw, range(10**6)))
    assert len(whole) > 20
    monkeypatch.setattr(sd, "BLOCK", 777)
    assert sd.items(raw) == whole
    split = sd.anchored(raw, sd.open_windows(raw, range(10**6)))

    def windows(found):
        return {(h, a + (form & 127), a + k) for h, a, form in found for k in range((form >> 7) + 1)}

    assert windows(split) == windows(anchors)
    assert all(h == int(sd.gram_hashes(raw, q, q + 1).view("<i8")[0]) and q - 76 <= p <= q for h, q, p in windows(anchors))
    for p in range(0, len(raw) - 99, 97):  # every window is in an item
        assert any(a <= p and p + 100 <= b for a, b in whole)


def test_memory_of_a_shard():
    """Of a shard's arrays, most of an executor's memory beside its heap: at most 70 bytes a symbol."""
    import tracemalloc

    rng = random.Random(1)
    base = [bytes(rng.choices(b"abcdefgh ", k=400)) for _ in range(50)]
    contexts = [b[a : a + rng.randrange(100, 176)] for b, a in ((rng.choice(base), rng.randrange(200)) for _ in range(3000))]
    tracemalloc.start()
    try:
        sd.repeated_windows(contexts)
        assert tracemalloc.get_traced_memory()[1] < 70 * sum(map(len, contexts))
    finally:
        tracemalloc.stop()


def test_short_texts_are_looked_at_together(monkeypatch):
    """Of 400 short texts, hashes are taken a few times, not for each text by itself."""
    rng, calls, hashed = random.Random(4), [], sd.gram_hashes
    texts = [bytes(rng.choices(b"abcdef ", k=rng.randrange(100, 300))).decode() for _ in range(400)]
    monkeypatch.setattr(sd, "gram_hashes", lambda *a: calls.append(a) or hashed(*a))
    keys = pa.array(range(400), pa.int64())
    firsts = pa.array([list(range(len(sd.items(t.encode())))) for t in texts], pa.list_(pa.int32()))
    calls.clear()
    (found,) = sd._anchors(iter([pa.RecordBatch.from_arrays([keys, pa.array(texts), firsts], names=["key", "text", "firsts"])]))
    assert len(calls) < 40
    want = {(k, lo + p) for k, t in enumerate(texts) for _, lo, form in sd.anchored(t.encode(), sd.open_windows(t.encode(), range(99))) for p in range((form >> 7) + 1)}
    assert {(r["key"], r["lo"] + p) for r in found.to_pylist() for p in range((r["form"] >> 7) + 1)} == want
    assert len(want) == sum(len(t) - 99 for t in texts)


def test_steps_keep_texts_apart(monkeypatch):
    """Empty and short texts between others, texts removed to their ends, texts longer than a step."""
    monkeypatch.setattr(sd, "BLOCK", 700)
    rng = random.Random(6)
    texts = ["", "é" * 60, "short", None, "z" * 150, "", "é" * 60, "z" * 150, "x" * 99, "ab" * 900, "z" * 100]
    texts += ["".join(rng.choices("abcé ", k=rng.randrange(400))) for _ in range(40)]
    ids = pa.array(range(len(texts)), pa.int64())
    (found,) = sd._item_digests(iter([pa.RecordBatch.from_arrays([ids, pa.array(texts)], names=["key", "text"])]))
    each = [(k << sd.ORD_BITS | i, hashlib.blake2b((t or "").encode()[a:b], digest_size=16).digest()) for k, t in enumerate(texts) for i, (a, b) in enumerate(sd.items((t or "").encode()))]
    assert [(r["place"], r["h1"].to_bytes(8, "little", signed=True) + r["h2"].to_bytes(8, "little", signed=True)) for r in found.to_pylist()] == each

    seen, repeats = set(), []
    for t in texts:  # every window's repeat is marked by itself, and every item is the first of its kind
        raw, own = (t or "").encode(), []
        for p in range(len(raw) - 99):
            own += [{"start": p, "stop": p + 1}] if raw[p : p + 100] in seen else []
            seen.add(raw[p : p + 100])
        repeats.append(own or None)
    firsts = [list(range(len(sd.items((t or "").encode())))) for t in texts]
    two = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.struct([("lo", pa.int32()), ("form", pa.int32())]))
    columns = [ids, pa.array(texts), pa.array(firsts, pa.list_(pa.int32())), pa.array(repeats, two[0]), pa.nulls(len(texts), two[1]), pa.nulls(len(texts), pa.list_(pa.int32()))]
    (out,) = sd._removed(iter([pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "firsts", "repeats", "hot", "hot_firsts"])]))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], [(s["start"], s["stop"]) for s in r["spans"]], r["kept_sha256"]) for r in out.to_pylist()]
    assert got == brute(list(enumerate(texts)))


def test_last_step_of_few_bytes(monkeypatch):
    raw = bytes(random.Random(9).choices(b"abcdef ", k=3000))
    for n in range(2900, 3000):
        monkeypatch.undo()
        whole = sd.items(raw[:n])
        monkeypatch.setattr(sd, "BLOCK", 1450)
        assert sd.items(raw[:n]) == whole


def test_equal_contexts_need_no_suffix_array(monkeypatch):
    """Copies of one context that shares no window with another text are told by their bytes alone."""
    rng, texts, sort = random.Random(5), [], sd.suffix_array
    monkeypatch.setattr(sd, "suffix_array", lambda text, length: texts.append(len(text)) or sort(text, length))
    lone, base = (bytes(rng.choices(b"abcdefgh ", k=170)) for _ in range(2))
    contexts = [lone] * 5 + [base[:130], base[20:], base[:130]]
    form = [(len(c) - 100) * 128 + a for c, a in zip(contexts, [60] * 6 + [40, 60], strict=True)]
    lo = [9] * len(contexts)
    shard = pa.table({"h": [1] * 5 + [2] * 3, "key": list(range(8)), "lo": pa.array(lo, pa.int32()), "form": pa.array(form, pa.int32()), "context": contexts, "shard": [0] * 8})
    rows = sd._shard_repeats(shard).to_pylist()
    assert {(r["key"], p) for r in rows for p in range(r["start"], r["stop"])} == {(k, 9 + p) for k in range(1, 5) for p in range(71)} | {(6, 9 + p) for p in range(11)} | {(7, 9 + p) for p in range(31)}
    assert sum(texts) == 130 + 150 + 2


def test_rows_of_a_long_prefix():
    rng = random.Random(7)
    for _ in range(200):
        text = np.array([rng.choice([97, 98, 256]) for _ in range(rng.randrange(1, 60))] if rng.random() < 0.6 else [97] * rng.randrange(1, 60) + [256], np.uint16)
        minimum = rng.randrange(1, 12)
        order = sd.suffix_array(text, minimum + 1)
        heads = [text[p : p + minimum].tolist() for p in order.tolist()]
        same = [False] + [a == b and len(a) == minimum for a, b in zip(heads, heads[1:], strict=False)]
        assert sd.long_prefix_rows(text, order, minimum).tolist() == same


@pytest.mark.parametrize("times", [2, 3])
def test_suffix_array(times):
    rng = random.Random(8)
    n = 3000 if times == 3 else (1 << 21) + 5
    text = np.frombuffer(rng.randbytes(n // 4), np.uint8).astype(np.uint16) % 3
    text = np.concatenate([text, text, text, text])[:n]
    order = sd.suffix_array(text, 20)
    raw = text.astype(np.uint8).tobytes()
    picked = [raw[p : p + 20] for p in order[:: 1 if times == 3 else 501].tolist()]
    assert picked == sorted(picked) and len(set(order.tolist())) == len(text)
