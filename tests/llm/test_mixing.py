import random
import re

from wordloom.llm import mixing


def shares(sizes):
    """Targets by the rule as it is told: share by weight, cap, share what is over among the rest, again and again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        got = {s: float(3 * sizes[s]) if s in capped else left * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and got[s] > 3 * sizes[s]}
        if not over:
            return got
        capped |= over


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string")
    return mixing.mix(docs).collect()


def corpus(rng, n, sources):
    return [(i, " ".join("w" for _ in range(int(rng.expovariate(1 / 60)))), rng.choice(sources), "x") for i in range(n)]


def test_targets_caps_and_taken(spark):
    rng = random.Random(2)
    rows = corpus(rng, 400, ["b"] * 12 + ["a", "É", "c", "d", "d", None]) + [(1000, "one\x1ctwo\x0bthree", "tiny", ""), (1001, None, "tiny", ""), (1002, "", "zero", ""), (None, "a b", "a", "")]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    by = {}
    for i, _, s, _ in rows:
        by[s] = by.get(s, 0) + size[i]
    want, got = shares(by), run(spark, rows)
    assert sorted(r.doc_id or -1 for r in got) == sorted(i or -1 for i, *_ in rows)
    source = {i: s for i, _, s, _ in rows}
    taken = {}
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == by[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    for s in by:
        assert abs(taken[s] - want[s]) <= 12, (s, taken[s], want[s])
    again = run(spark, rows[::-1])
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_edges(spark):
    assert run(spark, []) == []
    assert [(r["size"], r.target, r.taken) for r in run(spark, [(1, "", "a", ""), (2, None, None, "")])] == [(0, 0.0, 0)] * 2
    got = run(spark, [(7, "a b c", "s", ""), (7, "a b c", "s", "")])  # a repeated row counts twice
    assert [(r.source_size, r.target, r.taken) for r in got] == [(6, 6.0, 3)] * 2


def test_schedule_is_even(spark):
    docs = spark.createDataFrame(corpus(random.Random(1), 300, list("abcde")), "doc_id bigint, text string, source string, size string")
    source = mixing.targets(mixing.sized(docs)).collect()
    table = spark.createDataFrame(source)
    rows = mixing.schedule(spark, table, 3000).collect()
    assert sorted(r.slot for r in rows) == list(range(3000))
    total = sum(s.target for s in source)
    for s in source:
        own = sorted(r.slot for r in rows if r.place == s.place)
        assert [r.nth for r in sorted((r for r in rows if r.place == s.place), key=lambda r: r.slot)] == list(range(len(own)))
        for begin in range(0, 3000, 300):  # every stretch has the target's share
            assert abs(sum(begin <= x < begin + 300 for x in own) - 300 * s.target / total) <= 5


def test_mixed_documents_keep_columns(spark):
    docs = spark.createDataFrame(corpus(random.Random(3), 200, ["a"] * 9 + ["b"]), "doc_id bigint, text string, source string, size string")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    for r in mixing.mix(docs).collect():
        assert times.get(r.doc_id, 0) == (int(r.taken / r["size"] + 0.5) if r["size"] else 0)


def test_small_sources_meet_their_targets(spark):
    """A source whose target is far below a block, beside large ones."""
    rows = [(i, " ".join(["w"] * 500), "big" if i % 3 else "large", "x") for i in range(300)] + [(900 + i, "a b c", "tiny", "x") for i in range(4)]
    got = run(spark, rows)
    tiny = [r for r in got if r.doc_id >= 900]
    assert sum(r.taken for r in tiny) == 36 == tiny[0].target
    for ids in (lambda i: i < 900 and i % 3, lambda i: i < 900 and not i % 3):
        own = [r for r in got if ids(r.doc_id)]
        assert 0 <= sum(r.taken for r in own) - own[0].target < 1


def test_slots_order_the_mix(spark):
    docs = spark.createDataFrame(corpus(random.Random(9), 300, ["a"] * 9 + ["b", "c"]), "doc_id bigint, text string, source string, size string")
    first = {r.doc_id: r.first_slot for r in mixing.mix(docs, block=64).collect()}
    assert all((first[r.doc_id] is not None) == (r.taken > 0) for r in mixing.mix(docs, block=64).collect())
    seen, order = set(), []
    for r in mixing.mixed_documents(docs, block=64).collect():
        if r.doc_id not in seen:
            order.append(first[r.doc_id])
            seen.add(r.doc_id)
    assert order == sorted(order) and len(set(order)) > 20


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 7, "m", 3, 4), (2, None, None, 8, None, 5, 6)], "doc_id bigint, text string, source string, times int, mixed_id string, mixed_slot int, row int")
    assert [tuple(r) for r in mixing.mixed_documents(docs).collect()] == [(1, "a b", "s", 7, "m", 3, 4)]
    assert mixing.mix(docs).count() == 2
    assert mixing.mixed_documents(docs.limit(0)).collect() == []
