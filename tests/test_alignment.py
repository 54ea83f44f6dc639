import difflib
import random
import re

import pytest
from wordloom.operators import quality
from wordloom.operators.anchors import matching_blocks
from wordloom.plans import QUERIES
from wordloom.plans.timing_queries import word_index

SF = "/root/testdata/sf0.001"


def plain(predicted, gold):
    costs = [list(range(len(gold) + 1))]
    for i, token in enumerate(predicted, 1):
        above, row = costs[-1], [i]
        for j, other in enumerate(gold, 1):
            row.append(above[j - 1] if token == other else 1 + min(above[j - 1], above[j], row[j - 1]))
        costs.append(row)
    i, j, pairs = len(predicted), len(gold), []
    while i and j:
        if predicted[i - 1] == gold[j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
            continue
        now = costs[i][j] - 1
        if costs[i - 1][j - 1] == now:
            i, j = i - 1, j - 1
        elif costs[i - 1][j] == now:
            i -= 1
        else:
            j -= 1
    return costs[-1][-1], pairs[::-1]


@pytest.mark.parametrize("columns", [256, 3, 1])
def test_alignment(monkeypatch, columns):
    monkeypatch.setattr(quality, "KEPT_COLUMNS", columns)
    rng = random.Random(columns)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(0, 40))] for _ in range(2))
        if rng.random() < 0.5:
            b = [x for x in a if rng.random() < 0.9]
        assert quality._alignment(a, b) == plain(a, b)


@pytest.mark.parametrize("columns", [7, 3, 1])
def test_alignment_of_a_table_not_held(monkeypatch, columns):
    monkeypatch.setattr(quality, "HELD_BYTES", 0)
    test_alignment(monkeypatch, columns)


def test_no_array_is_made_for_each_word(spark):
    """A field of the array of words, taken within a lambda, would be gathered anew for each word: quadratic work."""
    words = spark.createDataFrame([(1, 0, "one", "one", 0.0, 0.5)], "doc_id int, index int, text string, token string, start double, end double")
    for df in (quality.quality_report(words, words), quality.alignments(words, words)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "lambdafunction" in plan and not re.search(r"[lr]#\d+\.\w+\[", plan)


def test_wer_report_has_all_words(spark):
    want = {r.doc_id: r["count"] for r in word_index(spark, SF).groupBy("doc_id").count().collect()}
    got = {r.doc_id: r.reference_word_count for r in QUERIES["wer_report"](spark, SF).collect()}
    assert max(want.values()) > 120 and all(want[i] == n for i, n in got.items())


@pytest.mark.parametrize("letters", ["a", "ab", "abcé🙂"])
def test_matching_blocks(letters):
    """The same pairs as difflib's."""
    rng = random.Random(7)
    for _ in range(400):
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(0, 50))) for _ in range(2))
        if rng.random() < 0.5:
            b = "".join(c for c in a if rng.random() < 0.9)
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        assert [(x + k, y + k) for x, y, n in matching_blocks(a, b) for k in range(n)] == [(x + k, y + k) for x, y, n in want for k in range(n)]
