import random

from test_substring_dedup import brute, run
from wordloom.llm import substring_dedup as sd


def test_short_lines(spark):
    verse = "\n".join(f"line {k} of verse" if k % 3 else f"so {k}" for k in range(20))
    han, thai = "今天天气很好我们去公园散步", "สวัสดีครับวันนี้อากาศดีมากเราไปเดินเล่นกัน"
    rows = [(1, verse), (2, "quite other\n" + verse + "\nends here"), (3, han), (4, "x\n" + han), (5, thai), (6, thai), (7, "yes"), (8, "yes"), (9, "ho ho\n" * 12)]
    left = {r.doc_id: r.text for r in run(spark, rows)}
    assert left[1] == verse and left[2].split() == ["quite", "other", "ends", "here"]
    assert left[3] == han and left[4].strip() == "x" and (left[5], left[6]) == (thai, "")
    assert left[7] == left[8] == "yes" and left[9].split() == ["ho"] * 6
    assert sorted(((r.doc_id, r.n_units, r.n_removed, r.text) for r in run(spark, rows)), key=str) == brute(rows)


def test_stretches_cover_repeats():
    rng = random.Random(4)
    for _ in range(300):
        parts = [f"{rng.random()} " * rng.randrange(1, 5) for _ in range(rng.randrange(2, 9))]
        parts = [p.strip() for p in parts]
        seen = {u for _, _, u in sd.units("\n".join(parts), 5, 8)}
        text = "a\nb c\n" + "\n".join(parts) + "\nd e f\ng"
        gone = bytearray(len(text))
        for a, b, u in sd.units(text, 5, 8):
            if u in seen:
                gone[a:b] = b"\1" * (b - a)
        enough = sum(len(p.split()) for p in parts) >= 5
        assert all(gone[text.index(p)] == enough for p in parts)


def test_short_sentences():
    tail = "I came here. I saw it all. I won it. And then?"
    a, b = (f"{start} {tail}" for start in ("One begins in some way with very many words.", "Another one begins with as many other words."))
    seen = {u for _, _, u in sd.units(a, 5, 8)}
    assert {i for s, e, u in sd.units(b, 5, 8) if u in seen for i in range(s, e)} == set(range(b.index(tail), len(b)))
