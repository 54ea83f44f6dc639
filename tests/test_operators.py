"""Operators against expectations written out, and against plain loops."""

import difflib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from wordloom.functions import text as T, times
from wordloom.operators import anchors as A, intervals as I, lineage as L, quality as Q, subtitles as S, timing as M, transcripts as R, validate as V
from wordloom.sources import config, files


def spans(df, *columns):
    columns = columns or ("start", "end")
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def intervals(spark, rows):
    return spark.createDataFrame([(1, float(a), float(b)) for a, b in rows], "doc_id int, start double, end double")


def doc(spark, duration):
    return spark.createDataFrame([(1, float(duration))], "doc_id int, duration double")


def column(spark, *exprs):
    return spark.range(1).select(*exprs).first()


def test_schedules(spark):
    assert spans(I.fixed_windows(doc(spark, 60), 28.0, 4.0), "window_index", "start", "end") == [(0, 0, 28), (1, 24, 52), (2, 48, 60)]
    assert spans(I.fixed_windows(doc(spark, 0), 28.0, 4.0)) == []
    assert spans(I.fixed_windows(doc(spark, 28), 28.0, 4.0)) == [(0, 28)]
    merged = I.merge_regions(intervals(spark, [(2, 4), (4.5, 8), (20, 22)]), 30.0, 0.35, 0.9, digits=3)
    assert spans(merged) == [(1.65, 8.35), (19.65, 22.35)]
    windows = spans(I.region_windows(merged, 4.0, 1.0), "window_index", "start", "end")
    assert windows[0] == (0, 1.65, 5.65) and windows[-1][2] == 22.35


def test_silence_and_cuts(spark):
    assert spans(I.silence_candidates(intervals(spark, [(6, 10), (12, 15)]), doc(spark, 22), 5.0)) == [(0, 6), (15, 22)]
    assert spans(I.silence_candidates(intervals(spark, [(0, 10)]), doc(spark, 10), 5.0)) == []
    cuts = I.subtract_protected(intervals(spark, [(0, 12)]), intervals(spark, [(5, 6)]), 5.0)
    assert spans(cuts) == [(0, 5), (6, 12)]
    assert spans(I.kept_regions(cuts, doc(spark, 15))) == [(5, 6), (12, 15)]
    cut = I.subtract_protected(I.silence_candidates(intervals(spark, [(0, 4), (10, 12)]), doc(spark, 12), 5.0), intervals(spark, [(0.5, 1), (10.5, 11)]), 5.0)
    assert spans(I.cut_summary(cut, doc(spark, 12)), "cut_count", "removed", "status") == [(1, 6.0, "cut")]
    assert I.keep_expression(I.kept_regions(cut, doc(spark, 12))).first().expression == "between(t,0.000,4.000)+between(t,10.000,12.000)"


def test_equal_bounds(spark):
    touching = intervals(spark, [(0, 1), (1.5, 2), (2, 3), (5, 5), (9, 8)])
    assert spans(I.merge_regions(touching, 10.0, 0, 0.5)) == [(0, 3)]
    assert spans(I.merge_regions(touching, 10.0, 0, 0.49)) == [(0, 1), (1.5, 3)]
    assert spans(I.silence_candidates(intervals(spark, [(5, 10)]), doc(spark, 15), 5.0)) == [(0, 5), (10, 15)]
    assert spans(I.silence_candidates(intervals(spark, []), doc(spark, 15), 5.0)) == [(0, 15)]


@pytest.mark.parametrize("seed", range(3))
def test_subtraction_and_overlap_against_loops(spark, seed):
    rng = random.Random(seed)
    cand = sorted({(a, a + rng.randrange(1, 30)) for a in (rng.randrange(200) for _ in range(12))})
    prot = [(a, a + rng.randrange(0, 12)) for a in (rng.randrange(220) for _ in range(15))]
    want = []
    for a, b in cand:
        free = [not any(p <= t < q for p, q in prot) for t in range(a, b)]
        for k in range(len(free)):
            if free[k] and (k == 0 or not free[k - 1]):
                end = next((j for j in range(k, len(free)) if not free[j]), len(free))
                want += [(a + k, a + end)] * (end - k >= 4)
    assert spans(I.subtract_protected(intervals(spark, cand), intervals(spark, prot), 4.0)) == sorted(want)
    got = spans(I.overlap_join(intervals(spark, cand), intervals(spark, [p for p in prot if p[1] > p[0]]), 7.0), "l_start", "l_end", "r_start", "r_end")
    assert got == sorted((a, b, p, q) for a, b in cand for p, q in prot if max(a, p) < min(b, q))


def test_stitch(spark):
    rows = [(1, 0, "The quick brown fox jumps over the lazy dog"), (1, 1, "over the lazy dog and keeps running"), (1, 2, " "), (2, 0, "a b"), (2, 1, "b c")]
    got = dict(spans(R.stitch(spark.createDataFrame(rows, "doc_id int, window_index int, text string")), "doc_id", "text"))
    assert got == {1: "The quick brown fox jumps over the lazy dog and keeps running", 2: "a b b c"}


def test_window_times():
    got = A.spread_windows([(0, 0.0, 2.0, ["a", "b", "c", "d"], ["a", "b", "c", "d"]), (1, 1.0, 3.0, ["c", "d", "e"], ["c", "d", "e"])])
    assert got[-1] == ("e", 2.0, 3.0, 1) and got[1][1:3] == (0.5, 1.0)


def test_gate(spark):
    rows = [(1, "loop one two three " * 30, 30.0), (2, "hi", 9.0), (3, "one two three four", 0.5), (4, "a calm and ordinary line of words", 9.0), (5, None, 1.0)]
    out = {r.doc_id: r for r in Q.transcript_quality(spark.createDataFrame(rows, "doc_id int, text string, d double"), F.col("d")).collect()}
    assert not out[1].ok and "consecutive_ngram_loop" in out[1].reasons and out[1].max_repeats == 30
    assert out[2].reasons == ["too_few_words"] and out[3].reasons == ["implausibly_fast"] and out[4].ok and out[5].reasons == ["too_few_words"]


def pieces(spark, text, most):
    return [r.text for r in R.sentence_lines(spark.createDataFrame([(1, text)], "doc_id int, text string"), most).orderBy("line").collect()]


def test_sentence_lines(spark):
    text = "Dr. Smith arrived at 3.5 p.m. He spoke clearly! Then everyone left"
    lines = pieces(spark, text, 8)
    assert " ".join(lines).split() == text.split() and len(lines) >= 2
    assert pieces(spark, "Go now. Then 3.5 or www.site.com Now. Ask?! \"Yes\" no... Well", 70) == ["Go now.", "Then 3.5 or www.site.com Now. Ask?!", "\"Yes\" no...", "Well"]
    assert pieces(spark, "", 70) == []
    long = " ".join(f"w{i}{',' if i == 49 else ''}" for i in range(100))
    assert [len(x.split()) for x in pieces(spark, long, 70)] == [50, 50]


def test_sentence_boundaries(spark):
    cases = [("end.", "Next", True), ("Mr.", "X", False), ("really?!\"", None, True), ("U.S.A.", "is", False), ("U.S.A.", "Is", True), ("word", "x", False), ("co.", "x", False), ("no,", None, False)]
    df = spark.createDataFrame(cases, "w string, n string, want boolean").select(T.is_sentence_boundary(F.col("w"), F.col("n")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_text_rules(spark):
    r = column(
        spark, times.ass_time(F.lit(3661239)).alias("a"), times.vtt_time(F.lit(-5)).alias("b"), times.vtt_time(F.lit(360000123)).alias("c"), T.slugify(F.lit("  Straße & Été! ")).alias("d"), T.slugify(F.lit("日本")).alias("e"),
        T.redact(F.lit("at /home/me/x C:\\a\\b https://h.org/p?k=1 hf_" + "a" * 25)).alias("f"), T.human_bytes(F.lit(1536)).alias("g"), T.squeezed(F.lit("a b​c \n d")).alias("h"),
        T.last_json_object(F.lit('x\n{"a":1}\n{"b":2}\n[3]\n{bad')).alias("i"), T.file_suffix(F.lit("/a/B.MP3")).alias("j"), T.file_suffix(F.lit("/a/noext")).alias("k"), T.ass_escape(F.lit("a{b}\\\n")).alias("l"),
        times.frames_per_second(F.lit("30000/1001")).alias("m"), times.frames_per_second(F.lit("1/0")).alias("n"), times.finite(F.lit("nan")).alias("o"), T.filter_path_escape(F.lit("C:\\a'b")).alias("p"),
    )
    assert r.a == "1:01:01.23" and r.b == "00:00:00.000" and r.c == "100:00:00.123" and r.d == "strasse-t" and r.e == "podcast"
    assert r.f == "at <local-path> <local-path> https://h.org/p?<redacted-query> <redacted-token>"
    assert r.g == "1.5 KiB" and r.h == "a bc d" and r.i == '{"b":2}' and r.j == ".mp3" and r.k == ".audio" and r.l == "a\\{b\\}\\\\ "
    assert abs(r.m - 29.97) < 0.01 and r.n == 0 and r.o is None and r.p == "C\\:\\\\a\\'b"


def test_unicode_words(spark):
    df = spark.createDataFrame([("ﬁne",), ("½x²",), ("İ",), ("don't!",), (None,)], "w string")
    got = df.select(T.normalize_word_nfkc("w").alias("a"), T.clean_word_nfkc("w").alias("b"), T.join_key_nfkc("w").alias("c")).collect()
    assert [r.a for r in got] == ["fine", "12x2", "i", "don't", None]
    assert got[2].b == "İ" and got[2].c == "i̇"


def test_urls(spark):
    cases = [("https://youtu.be/abc123", True), ("https://www.youtube.com/playlist?list=x", False), ("https://youtu.be/a?LIST=x", False), ("https://u:p@youtu.be/a", False), ("https://evil.org/a", False), ("file:///a", False), ("https://youtube.com.evil.org/a", False), ("https://youtu.be/", False)]
    df = spark.createDataFrame(cases, "u string, want boolean").select(T.url_allowed(F.col("u"), ("youtube.com", "youtu.be")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_quality_report(spark):
    schema = "doc_id int, index int, text string, clean string, start double, end double"
    said = spark.createDataFrame([(1, 0, "One,", "One", 0.1, 0.4), (1, 1, "extra", "extra", 0.4, 0.6), (1, 2, "three.", "three", 0.7, 1.1)], schema)
    gold = spark.createDataFrame([(1, 0, "one", 0.0, 0.5), (1, 1, "two", 0.5, 0.7), (1, 2, "three", 0.8, 1.0)], "doc_id int, index int, text string, start double, end double")
    meta = spark.createDataFrame([(1, 2, 2 / 3)], "doc_id int, effective_words int, coverage double")
    r = Q.quality_report(said, gold, meta).first()
    assert (r.word_errors, round(r.wer, 6), r.timing_matched_words) == (1, 0.333333, 2)
    assert (r.boundary_error_median, r.boundary_error_p95, r.application_rate) == (0.1, 0.1, 0.666667)


def test_distance_and_alignment(spark):
    rng = random.Random(1)
    pairs = [(k, [rng.choice("abcdé") for _ in range(rng.randrange(0, 14))], [rng.choice("abcdé") for _ in range(rng.randrange(0, 14))]) for k in range(40)]
    got = {r.k: r.distance for r in Q.word_distance(spark.createDataFrame(pairs, "k int, a array<string>, b array<string>"), "a", "b").collect()}
    for k, a, b in pairs:
        distance, matched = Q._alignment(a, b)
        assert got[k] == distance and all(a[i] == b[j] for i, j in matched)
        table = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                table[i, j] = i + j if not i or not j else min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        assert distance == table[len(a), len(b)]


def test_fuzzy_align(spark):
    a, b = "the quick brown fox jumps".split(), "a quick red fox jumps high".split()
    frame = lambda t: spark.createDataFrame([(1, i, w) for i, w in enumerate(t)], "doc_id int, index bigint, token string")
    want = [(x + k, y + k) for x, y, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for k in range(n)]
    assert spans(A.fuzzy_align(frame(a), frame(b)), "left_index", "right_index") == want


def test_characters_to_words():
    rows, mode = A.words_from_characters(["hello", "world"], [("hello", 0.1, 0.5), ("world", 0.6, 1.0)], 1.2)
    assert mode == "char_exact" and rows[0][0] == 0.1 and rows[1][1] == 1.0
    rows, mode = A.words_from_characters(["ab", "zz", "cd"], [("ab", 0.0, 0.4), ("cd", 0.8, 1.0)], 2.0)
    assert mode == "char_partial" and rows[1] == (0.4, 0.8)
    assert A.words_from_characters(["ab"], [("xy", 0, 1)], 1.0) is None and A.words_from_characters([], [("a", 0, 1)], 1.0) is None


def test_cut_segments():
    assert A.cut_segments(5, [None] * 5, most=2) == [(0, 2), (2, 4), (4, 5)]
    assert A.cut_segments(4, [0.0, 1.0, 20.0, 21.0]) == [(0, 2), (2, 4)]
    assert A.cut_segments(4, [0.0, None, 20.0, None]) == [(0, 1), (1, 4)]
    assert A.cut_segments(6, [0.0, 7.0, 14.0, 21.0, 28.0, 36.0]) == [(0, 5), (5, 6)]
    assert A.cut_segments(0, []) == []


def words(spark, rows, **extra):
    pdf = pd.DataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(rows)], columns=["doc_id", "index", "start", "end"])
    return spark.createDataFrame(pdf.assign(**extra))


def test_interpolation(spark):
    known = spark.createDataFrame([(1, 2, 4.0, 5.0), (1, 4, 9.0, 10.0)], "doc_id bigint, index bigint, start double, end double")
    got = spans(A.interpolated(words(spark, [(0, 0)] * 7).select("doc_id", "index"), known), "index", "start", "end")
    assert got == [(0, 1.0, 2.0), (1, 2.0, 3.0), (2, 4.0, 5.0), (3, 7.0, 9.0), (4, 9.0, 10.0), (5, 11.0, 12.0), (6, 12.0, 13.0)]


def test_coverage_gate(spark):
    w = words(spark, [(0, 0)] * 4).select("doc_id", "index")
    one = spark.createDataFrame([(1, 0, 0.0, 0.5)], "doc_id bigint, index bigint, start double, end double")
    assert not A.anchor_coverage(w, one).first().enough and A.anchor_coverage(w, w).first().coverage == 1.0


def test_focus_spans(spark):
    got = M.focus_spans(words(spark, [(0.1, 0.1), (0.1, 0.1), (0.1, 0.2)], duration=1.0)).orderBy("index").collect()
    assert all(r.fits and r.focus_start < r.focus_end for r in got)
    assert all(a.focus_end <= b.focus_start for a, b in zip(got, got[1:], strict=False))
    assert not any(r.fits for r in M.focus_spans(words(spark, [(0, 0)] * 9, duration=0.1)).collect())


def test_conflicts():
    at, fate, moved = M.settle_conflicts(np.array([[0.0, 0.4], [0.7, 0.2], [0.8, 1.2]]), np.array([[0.0, 0.4], [0.4, 0.8], [0.8, 1.2]]))
    assert (fate.tolist(), moved, at[1].tolist()) == ([M.OWN, M.FELL, M.OWN], 0, [0.4, 0.8])
    at, fate, moved = M.settle_conflicts(np.array([[0.0, 0.5], [0.3, 0.9]]), np.array([[0, 0.4], [0.4, 1]]))
    assert (fate.tolist(), moved) == ([M.MOVED, M.MOVED], 1) and at[0, 1] == at[1, 0] == 0.4
    with pytest.raises(ValueError):
        M.settle_conflicts(np.array([[1.0, 0.0]]), np.array([[1.0, 0.0]]))


def rounds_over_all(own, safe):
    """The rule told plainly: every round looks at every word and every boundary."""
    at, fell, adjusted, moved = [list(x) for x in own], set(), set(), 0

    def fall(which):
        for i in which:
            at[i] = list(safe[i])
            fell.add(i)

    for _ in own:
        back = [i for i, (a, b) in enumerate(at) if b < a]
        fall(back)
        both, shifts = set(), 0
        for i in range(len(at) - 1):
            if at[i][1] > at[i + 1][0]:
                if at[i][0] <= at[i + 1][1]:
                    at[i][1] = at[i + 1][0] = round(min(max((at[i][1] + at[i + 1][0]) / 2, at[i][0]), at[i + 1][1]), 3)
                    shifts += 1
                    adjusted |= {i, i + 1}
                else:
                    both |= {i, i + 1}
        fall(both)
        moved += shifts
        if not (back or both or shifts):
            return at, fell, adjusted - fell, moved
    for _ in range(len(own) + 1):
        bad = {i for i, (a, b) in enumerate(at) if b < a} | {k for i in range(len(at) - 1) if at[i][1] > at[i + 1][0] for k in (i, i + 1)}
        if not bad:
            return at, fell, adjusted - fell, moved
        fall(bad)
    raise AssertionError


def test_conflicts_against_rounds_over_all():
    rng, seen = random.Random(8), [0, 0]
    for _ in range(400):
        n = rng.randrange(1, 14)
        cuts = sorted(rng.randrange(0, 60) / 4 for _ in range(2 * n))
        safe = [cuts[2 * i : 2 * i + 2] for i in range(n)]
        own = [[a + rng.choice([0, 0, 0, 3, -2.5, 9]), b + rng.choice([0, 0, 0, 4, -3, -8])] for a, b in safe]
        at, fell, adjusted, moved = rounds_over_all(own, safe)
        got, fate, count = M.settle_conflicts(np.array(own), np.array(safe))
        assert got.tolist() == at and count == moved
        assert {i for i in range(n) if fate[i] == M.FELL} == fell and {i for i in range(n) if fate[i] == M.MOVED} == adjusted
        again, _, more = M.settle_conflicts(got, np.array(safe))  # what is settled stays as it is
        assert again.tolist() == at and more == 0
        seen[0] += len(fell)
        seen[1] += moved
    assert min(seen) > 200


def test_isotonic_against_minimax():
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, 60) + np.arange(60) * 0.3
    got, blocks = M.pool_adjacent(v, 0.1)
    w = v - np.arange(60) * 0.1
    want = [max(min(w[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(got - np.arange(60) * 0.1, want) and 1 < blocks <= 60


def test_cleanup_keeps_order(spark):
    rng = random.Random(2)
    w = words(spark, [(t := rng.uniform(0, 50), t + rng.uniform(-0.1, 4)) for _ in range(80)], duration=60.0)
    coarse = spark.createDataFrame([(1, i, i * 0.6, i * 0.6 + 0.5) for i in range(0, 80, 2)], "doc_id bigint, index bigint, start double, end double")
    got = M.acoustic_cleanup(w, coarse)
    rows = got.orderBy("index").collect()
    assert all(r.end - r.start >= 0.005 - 1e-9 for r in rows) and all(a.end <= b.start + 1e-6 for a, b in zip(rows, rows[1:], strict=False))
    assert M.monotonic(got.withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})).count() == 1 and M.cleanup_report(got).first().guarded_words > 0


def test_violations(spark):
    docs = doc(spark, 2)
    schema = "doc_id int, index int, text string, clean string, source string, sentence_index int, chunk_index int, start double, end double, focus_start double, focus_end double"
    good = [(1, 0, "A", "A", "s", 0, 0, 0.0, 0.5, 0.0, 0.5), (1, 1, "b", "b", "s", 0, 0, 0.5, 0.5, 0.5, 0.6)]
    ranges = lambda *r: spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate(r)], "doc_id int, index int, word_start int, word_end int")
    run = lambda rows, s, c: {(r.rule, r["index"]) for r in V.violations(docs, spark.createDataFrame(rows, schema), s, c).collect()}
    assert run(good, ranges((0, 2)), ranges((0, 2))) == set()
    assert run(good, ranges((0, 1)), ranges((0, 2))) == {("C9", 0), ("C10", 1)}
    bad = [good[0], (1, 2, " ", "", "s", 0, 0, 0.4, float("nan"), 0.7, 0.7)]
    assert {r for r, _ in run(bad, ranges((0, 2)), ranges((0, 2)))} >= {"C2", "C3", "C4", "C6", "C7"}
    assert {r for r, _ in run([], ranges(), ranges())} == {"C1"}


def test_lineage(spark, tmp_path):
    stages = spark.createDataFrame([("a", 1, "x", "s", "m"), ("a", 1, "x", "s", "m"), ("a", 2, "x", "s", "m")], "name string, schema_version int, inputs string, settings string, models string")
    prints = [r.fingerprint for r in L.stage_fingerprints(stages).collect()]
    assert prints[0] == prints[1] != prints[2]
    built = []
    build = lambda: built.append(1) or spark.range(3)
    for _ in range(2):
        assert L.materialised(spark, str(tmp_path), prints[0], build).count() == 3
    assert built == [1]
    cp = spark.createDataFrame([("f", [("a", "1"), ("b", "2")]), ("g", [("a", "9")]), ("h", [("../a", "1")])], "fingerprint string, artifacts array<struct<path:string,sha256:string>>")
    have = spark.createDataFrame([("a", "1"), ("b", "2"), ("../a", "1")], "path string, sha256 string")
    assert spans(L.valid_artifacts(cp, have), "fingerprint", "valid") == [("f", True), ("g", False), ("h", False)]


def test_layouts_and_json_prefix(spark):
    rect = '{"x":1,"y":1,"width":%s,"height":2,"textX":1,"textY":1,"textWidth":1,"textHeight":1,"fontSize":9,"text":"%s"}'
    lines = [(1, 0, '{"sentence_index":0,"words":[' + rect % (3, "a") + "]}"), (1, 1, '{"sentence_index":1,"words":[' + rect % (0, "b") + "]}"), (1, 2, '{"sentence_index":2,"wo'), (1, 3, '{"sentence_index":3,"words":[]}')]
    got = files.valid_prefix(spark.createDataFrame(lines, "doc_id int, line int, value string"), files.LAYOUT, "doc_id")
    assert [r.sentence_index for r in got.orderBy("line").collect()] == [0, 1]
    texts = spark.createDataFrame([(1, 0, ["a"]), (1, 1, ["b"])], "doc_id int, sentence_index bigint, texts array<string>")
    assert spans(L.valid_layouts(got, texts), "sentence_index", "valid") == [(0, True), (1, False)]


def test_files(spark, tmp_path):
    grid = 'item []:\n item [1]:\n name = "phones"\n intervals [1]:\n xmin = 0 \n xmax = 1 \n text = "p" \n item [2]:\n name = "Words"\n intervals [1]:\n xmin = 0 \n xmax = 0.5 \n text = "say ""hi""" \n intervals [2]:\n xmin = 0.5 \n xmax = 1 \n text = " " \n'
    (tmp_path / "g").mkdir()
    (tmp_path / "g/utt_00000.TextGrid").write_text(grid)
    assert spans(files.grid_words(spark, f"{tmp_path}/g"), "utterance_id", "pos", "start", "end", "label") == [("utt_00000", 0, 0.0, 0.5, 'say "hi"')]
    (tmp_path / "c").mkdir()
    for name, text in (("chunk_002.txt", "b [x] c"), ("chunk_001.txt", "[tag] a"), ("other.txt", "no")):
        (tmp_path / "c" / name).write_text(text)
    assert [(r.chunk_index, r.text) for r in files.chunk_files(spark, f"{tmp_path}/c").collect()] == [(1, "a"), (2, "b c")]
    (tmp_path / "v").mkdir()
    (tmp_path / "v/rec.json").write_text('{"regions": [[0.5, 2], [3, 4.25]]}')
    (tmp_path / "v/bad.json").write_text('{"regions": [[0.5')
    assert spans(files.speech_regions(spark, f"{tmp_path}/v"), "doc_id", "start", "end")[-2:] == [("rec", 0.5, 2.0), ("rec", 3.0, 4.25)]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/rec.json").write_text('{"windows": {"10": {"start": 1, "end": 2, "text": "x", "quality": {"ok": true, "reasons": []}}, "2": {"start": 0, "end": 1, "text": "y"}}}')
    assert spans(files.stt_windows(spark, f"{tmp_path}/w"), "window_index", "text") == [(2, "y"), (10, "x")]
    media = files.media_files(spark, f"{tmp_path}/c/other.txt").first()
    assert (media.size_bytes, media.suffix, len(media.sha256)) == (2, ".txt", 64)


def test_settings(tmp_path):
    (tmp_path / "s.toml").write_text('data_root = "d"\n[speech]\nwindow_seconds = 20.0\n')
    s = config.load(tmp_path / "s.toml")
    assert s.speech.window_seconds == 20 and s.data_root == str(tmp_path / "d")
    for bad in ({"x": 1}, {"speech": {"windows": 1}}, {"speech": {"window_seconds": -1}}, {"output": {"fps": float("nan")}}, {"speech": {"overlap_seconds": 99}}):
        with pytest.raises(ValueError):
            config.from_mapping(bad)


def test_subtitles(spark):
    schema = "doc_id int, sentence_index int, index int, text string, s_start bigint, s_end bigint, focus_start bigint, focus_end bigint"
    w = spark.createDataFrame([(1, 0, 0, "Hello", 1800200, 1801000, 1800200, 1800600), (1, 0, 1, "world", 1800200, 1801000, 1800600, 1801000)], schema)
    box = F.struct(*[F.lit(float(v)).alias(k) for k, v in dict(x=10, y=20, width=100, height=50, textX=15, textY=25, textWidth=90, textHeight=40, fontSize=48).items()])
    seg = spark.createDataFrame([(1, 0, 1800000, 1802000)], "doc_id int, segment int, start bigint, end bigint")
    text = S.ass_documents(S.ass_events(w.withColumn("rect", box), seg), 1920, 1080).first().ass
    assert "0:00:00.20" in text and "0:00:01.00" in text and text.startswith("﻿[Script Info]") and text.count("Dialogue: 3") == 2
    assert r"{\fnGeist\b1\an5\pos(60.00,45.00)\fs48" in text and "m 23.00 20.00 l 97.00 20.00 b 110.00 20.00" in text


def test_streamed_regions(spark, tmp_path):
    from wordloom.streaming.regions import stream_counts, stream_regions

    rows = [(1, 0, 10), (1, 5, 30), (1, 35, 40), (1, 60, 61), (2, 0, 1), (3, 100000, 100001)]
    at = lambda c: F.timestamp_seconds(F.col(c) + 1_700_000_000)
    source = spark.createDataFrame(rows, "doc_id int, a int, b int").select("doc_id", at("a").alias("start"), at("b").alias("end"))
    source.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    for name, df in (("merged", stream_regions(stream, "5 seconds", "10 seconds")), ("counted", stream_counts(stream.select("doc_id", F.col("start").alias("ts")), "20 seconds", None, "10 seconds"))):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    got = {(r.doc_id, r.pieces, int(r.end.timestamp() - r.start.timestamp())) for r in spark.table("merged").collect()}
    assert got == {(1, 3, 40), (1, 1, 1), (2, 1, 1)}
    assert {(r.doc_id, r.words) for r in spark.table("counted").collect()} == {(1, 2), (1, 1), (2, 1)}
