import random

from wordloom.llm import substring_dedup as sd


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, kept int")
    return sd.substring_dedup(docs, 5, 8).collect()


def brute(rows):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        text = text or ""
        gone, n, removed = bytearray(len(text)), 0, 0
        for a, b, unit in sd.units(text, 5, 8):
            n += 1
            if unit in seen:
                removed += 1
                gone[a:b] = b"\1" * (b - a)
            seen.add(unit)
        out.append((i, n, removed, "".join(c for c, g in zip(text, gone, strict=True) if not g)))
    return sorted(out, key=str)


def test_units():
    text = "  One two three four five.\nshort line\n\nA b c d e f g h. Then only four words! Now come eight more words in a row"
    got = sd.units(text, 5, 8)
    assert [text[a:b] for a, b, _ in got] == [
        "One two three four five.", "A b c d e f g h. Then only four words! Now come eight more words in a row", "A b c d e f g h.", "Now come eight more words in a row",
    ]
    assert got[0][2] == "one two three four five." and sd.units("", 5, 8) == [] == sd.units(" \n\t\n", 5, 8)


def test_against_a_loop(spark):
    rng = random.Random(1)
    lines = [" ".join(rng.choice(["río", "Über", "sea", "hill", "to", "a."]) for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(lines).upper() if rng.random() < 0.2 else "  ".join(rng.choice(lines).split(" ")) for _ in range(rng.randrange(0, 12)))) for i in range(80)]
    rows += [(None, lines[0]), (-5, None), (900, ""), (901, lines[3] * 2000)]
    got = run(spark, rows)
    assert sorted(((r.doc_id, r.n_units, r.n_removed, r.text) for r in got), key=str) == brute(rows)
    texts = dict(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        assert "".join(text[s.start : s.stop] for s in r.kept) == r.text
        assert sum(s.stop - s.start for s in [*r.kept, *r.removed]) == len(text)


def test_repeats_and_empty(spark):
    line = "this line has more than five words"
    got = run(spark, [(1, line), (1, line), (2, line + "\nand one of its own that stays here")])
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 1), (2, 1)]
    assert run(spark, []) == []


def test_no_unit_removes_itself(spark):
    """A line of short sentences is also the stretch of them all: one unit, which no other repeats."""
    text = "A few words. And some more. Then the last of them here.\nno no"
    assert [u[2] for u in sd.units(text, 5, 8)].count("a few words. and some more. then the last of them here.") == 1
    assert [r.text for r in run(spark, [(1, text), (2, "quite another text of more words. yes. no. so it goes on and on.")])] and all(r.n_removed == 0 for r in run(spark, [(1, text)]))


def test_every_line_by_default(spark):
    docs = spark.createDataFrame([(1, "a\nb b\n\nA"), (2, "c\nB  B"), (3, "a b b")], "doc_id bigint, text string")
    assert {r.doc_id: (r.text, r.n_removed) for r in sd.substring_dedup(docs).collect()} == {1: ("a\nb b\n\n", 1), 2: ("c\n", 1), 3: ("a b b", 0)}


def test_rank_of_rows(spark):
    from pyspark.sql import functions as F
    from wordloom.llm.suffix_dedup import numbered

    rows = [(i % 50 - 25 if i % 7 else None, f"t{i}") for i in range(300)]
    got = numbered(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), [F.col("doc_id").asc_nulls_first(), F.col("text").asc()]).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.doc_id, r.text) for r in sorted(got, key=lambda r: r.key)] == want and sorted(r.key for r in got) == list(range(300))
