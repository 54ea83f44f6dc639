"""Queries that SQL can't check, over their own table, against plain versions; and text rules against Python's tables."""

import difflib
import random
import re
import unicodedata
from collections import defaultdict
from statistics import median

from pyspark.sql import functions as F
from test_alignment import plain
from test_operators import rounds_over_all
from wordloom.functions import text as T
from wordloom.operators import quality as Q, timing as M
from wordloom.plans import QUERIES
from wordloom.plans.text_queries import documents, word_index
from wordloom.plans.timing_queries import aligned

SF = "/root/testdata/sf0.001"


def grouped(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out


def test_fuzzy_align(spark):
    turns = grouped(spark.read.parquet(f"{SF}/conversations.parquet").collect(), lambda r: r.conv_id)
    want = set()
    for conv, own in turns.items():
        sides = ([], [])
        for r in sorted(own, key=lambda r: r.turn):
            sides[r.turn % 2].extend((r.turn * 100_000 + k, w) for k, w in enumerate(re.split(r"\s+", r.text.lower())))
        a, b = sides
        if a and b:
            for x, y, n in difflib.SequenceMatcher(None, [w for _, w in a], [w for _, w in b], autojunk=False).get_matching_blocks():
                want |= {(conv, a[x + k][0], b[y + k][0]) for k in range(n)}
    got = {(r.doc_id, r.left_index, r.right_index) for r in QUERIES["fuzzy_align"](spark, SF).collect()}
    assert got == want and want


def test_wer_distance(spark):
    tokens = {r.doc_id: re.findall(r"[^\W_]+(?:'[^\W_]+)?", r.text.casefold()) for r in documents(spark, SF).collect()}
    got = {r.doc_id: r.distance for r in QUERIES["wer_distance"](spark, SF).collect()}
    assert set(got) == {i for i in tokens if i + 1 in tokens}
    some = [i for i in got if len(tokens[i]) * len(tokens[i + 1]) < 60_000]
    assert len(some) > 50 and all(got[i] == plain(tokens[i], tokens[i + 1])[0] for i in some)


def test_distance_of_very_many_tokens():
    rng = random.Random(1)
    a = [str(i) for i in range(70_000)]
    b = [t for t in a if rng.random() < 0.999]
    assert Q.edit_distance(a, b) == len(a) - len(b)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 80))] for _ in range(2))
        assert Q.edit_distance(a, b) == plain(a, b)[0]


def test_wer_report(spark):
    words = grouped(word_index(spark, SF).collect(), lambda r: r.doc_id)
    got = {r.doc_id: r for r in QUERIES["wer_report"](spark, SF).collect()}
    seen = 0
    for doc, own in words.items():
        if len(own) > 250:
            continue
        own.sort(key=lambda r: r["index"])
        gold = [(r["index"] * 0.4, r["index"] * 0.4 + 0.3, r.clean) for r in own]
        said = [(s + 0.05, e, w + "x" * ((i + doc) % 13 == 0)) for i, (s, e, w) in enumerate(gold) if (i * 31 + doc) % 17]
        if not said:
            continue
        fold = lambda w: "".join(c for c in unicodedata.normalize("NFKC", w).casefold() if c == "'" or unicodedata.category(c)[0] in "LN")
        distance, pairs = plain([fold(w) for _, _, w in said], [fold(w) for _, _, w in gold])
        errors = [abs(x - y) for i, j in pairs for x, y in zip(said[i][:2], gold[j][:2], strict=True)]
        r = got[doc]
        assert (r.word_errors, r.timing_matched_words, r.boundary_sample_count, r.problem) == (distance, len(pairs), len(errors), None)
        assert not errors or abs(r.boundary_error_median - median(errors)) < 1e-6
        seen += 1
    assert seen > 50


def test_what_cannot_be_judged(spark):
    schema = "doc_id int, index int, text string, start double, end double"
    gold = spark.createDataFrame([(d, 0, "one", 0.0, 0.5) for d in (1, 2, 3)], schema)
    said = spark.createDataFrame([(1, 0, "one", 0.0, float("nan")), (2, 0, "one", 0.0, 0.5), (2, 1, "?!", 0.5, 0.6), (3, 0, "one", 0.1, 0.5)], schema)
    got = {r.doc_id: r for r in Q.quality_report(said, gold).collect()}
    assert [got[d].problem for d in (1, 2, 3)] == ["bound not finite", "empty token", None]
    assert got[1].word_errors is got[2].wer is None and got[3].wer == 0


def sentences(text, most=70):
    """The splitter told plainly, character by character."""
    t, starts = " ".join(text.replace("​", "").split()), [0]
    for i, c in enumerate(t):
        if c not in ".?!" or t[i : i + 2] == "..":
            continue
        j = i + 1
        while j < len(t) and t[j].isspace():
            j += 1
        if j >= len(t) or t[j] not in "\"'([{ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
            continue
        if c == ".":
            word = re.search(r"[A-Za-z.]+$", t[: i + 1])
            digits = i > 0 and i + 1 < len(t) and t[i - 1].isdigit() and t[i + 1].isdigit()
            if word and word[0].casefold() in T.LINE_ABBREVIATIONS or digits or re.search(r"\.(?:com|org|net|io|ai|co|tv)\b", t[max(0, i - 18) : i + 12], re.I):
                continue
        starts.append(j)
    for a, b in zip(starts, [*starts[1:], len(t)], strict=True):
        words = t[a:b].split()
        while len(words) > most:
            cut = next((k for k in range(most, max(20, most // 2), -1) if words[k - 1][-1] in ".?!,;:"), most)
            yield " ".join(words[:cut])
            words = words[cut:]
        if words:
            yield " ".join(words)


def test_sentence_lines(spark):
    got = grouped(QUERIES["sentence_lines"](spark, SF).collect(), lambda r: r.doc_id)
    docs = documents(spark, SF).collect()
    for r in docs:
        assert [x.text for x in sorted(got[r.doc_id], key=lambda x: x.line)] == list(sentences(r.text or ""))
    assert len(docs) >= 200


def test_character_alignment(spark):
    words = grouped(word_index(spark, SF).collect(), lambda r: (r.doc_id, r["index"] // 60))
    got = {(r.doc_id, r["index"]): (r.start, r.end, r.mode) for r in QUERIES["character_alignment"](spark, SF).collect()}
    checked = 0
    for (doc, _), own in sorted(words.items())[:250]:
        own.sort(key=lambda r: r["index"])
        pieces = defaultdict(str)
        for r in own:
            pieces[r["index"] // 2] += r.clean.lower()
        timed = []
        for pair, text in pieces.items():
            text = text[1:] if pair % 3 == 0 else text
            timed += [(c, pair % 30 + 0.9 * k / len(text), pair % 30 + 0.9 * (k + 1) / len(text)) for k, c in enumerate(text)]
        want, have = "".join(r.clean.lower() for r in own), "".join(c for c, _, _ in timed)
        if not have:
            continue
        at = {}
        for x, y, n in [(0, 0, len(want))] if want == have else difflib.SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks():
            at |= {x + k: timed[y + k][1:] for k in range(n)}
        place = 0
        for r in own:
            mine = [at[k] for k in range(place, place + len(r.clean.lower())) if k in at]
            place += len(r.clean.lower())
            if mine:
                start, end, mode = got[doc, r["index"]]
                assert abs(start - min(s for s, _ in mine)) < 1e-6 and abs(end - min(30.0, max(max(e for _, e in mine), start + 0.005))) < 1e-6
                assert mode == ("char_exact" if want == have else "char_partial")
                checked += 1
    assert checked > 1000


def test_conflict_resolution(spark):
    words = grouped(aligned(spark, SF).collect(), lambda r: r.doc_id)
    got = grouped(QUERIES["conflict_resolution"](spark, SF).collect(), lambda r: r.doc_id)
    assert set(got) == set(words)
    for doc, own in words.items():
        own.sort(key=lambda r: r["index"])
        end = [r.end + r.event_id % 5 * 20_000.0 - (100_000.0 if r.event_id % 7 == 0 else 0.0) for r in own]
        at, fell, adjusted, moved = rounds_over_all([[r.start, e] for r, e in zip(own, end, strict=True)], [[r.start, r.start] for r in own])
        found = sorted(got[doc], key=lambda r: r["index"])
        assert [[r.start, r.end] for r in found] == at
        assert {r["index"] for r in found if r.source == M.FALLBACK} == {own[i]["index"] for i in fell}
        assert {r["index"] for r in found if r.source == M.ADJUSTED} == {own[i]["index"] for i in adjusted if own[i]["index"] % 2 == 0}
        assert {(r.fallback_words, r.boundary_adjustments) for r in found} == {(len(fell), moved)}


def test_folding_of_any_text(spark):
    rng = random.Random(2)
    letters = "aZ'_é ßẞÏİıſŉΣςµﬁ½²Ⅳﷺ①Ａｶﾞ가각́ ЯЇ日本ǄԱև" + "".join(chr(rng.randrange(0x80, 0x2FFF)) for _ in range(300))
    lines = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 12))) for _ in range(500)] + [None, "", "plain words"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(lines)], "i int, w string")
    w = F.col("w")
    rows = df.select("w", T.folded(w).alias("f"), T.normalize_word(w).alias("n"), T.clean_word(w).alias("c"), T.clean_words(w).alias("cs"), T.stitch_keys(w).alias("k")).collect()
    kept = lambda t: "".join(c for c in t if c == "'" or unicodedata.category(c)[0] in "LN")
    for r in rows:
        if r.w is None:
            assert (r.f, r.n, r.c) == (None, None, None)
            continue
        assert r.f == r.w.casefold()
        assert r.n == kept(unicodedata.normalize("NFKC", r.w).casefold())
        assert r.c == kept(unicodedata.normalize("NFKC", r.w))
        assert r.cs == [kept(unicodedata.normalize("NFKC", t)) for t in r.w.split()]
        assert len(r.k) == len(r.w.split())
