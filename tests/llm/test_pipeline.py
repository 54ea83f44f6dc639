"""Every stage of the pipeline against a plain version on its own input."""

import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from pyspark.sql import functions as F
from test_shingle_dedup import shingles
from test_simhash import plain as plain_fingerprint
from wordloom.llm import mixing, packing, quality
from wordloom.llm.common import shared_folder, written

SF = "/root/testdata/sf0.001"


def small_letters(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = docs.filter("doc_id < 30").withColumns({"doc_id": F.col("doc_id") + 1000, "text": F.upper("text")})
    near = docs.filter("doc_id < 60").withColumns({"doc_id": F.col("doc_id") + 2000, "text": F.concat("text", F.lit(" more"))})
    docs = docs.unionByName(copies).unionByName(near)
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF))
        before, after = docs.collect(), out.collect()
        ids = {r.doc_id: r for r in before}
        seen.append((name, len(before), len(after)))
        if name != "packing":
            assert out.columns == columns
            assert all(ids[r.doc_id] == r for r in after)
        got = Counter(r.doc_id for r in after)
        if name == "quality classifier":
            model = quality.fit_on_documents(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(got) == {r.doc_id for r in before if model.score(quality.features(r.text)) >= 0.3}
            good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1 and r.doc_id in ids}
            assert len(good & set(got)) >= 0.97 * len(good)
        elif name == "exact dedup":
            last = {}
            for r in before:
                last[small_letters(r.text)] = max(last.get(small_letters(r.text), -1), r.doc_id)
            assert got == Counter(last.values())
        elif name == "SimHash near-dedup":
            prints = {i: plain_fingerprint(r.text) for i, r in ids.items()}
            root = {i: i for i in ids}

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            for a in ids:
                for b in ids:
                    if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3:
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
            # one of each SimHash group stays; then one of each group that shares five-word shingles
            left = {i: shingles(ids[i].text) for i in ids if find(i) == i}
            order, before_, root = list(left), None, {i: i for i in left}
            alike_ = [(a, b) for a in order for b in order if a < b and (left[a] == left[b] or len(left[a] & left[b]) >= 0.8 * len(left[a] | left[b]))]
            while root != before_:
                before_ = dict(root)
                for a, b in alike_:
                    root[a] = root[b] = min(root[a], root[b])
            assert got == Counter(i for i in left if root[i] == i) and len(got) < len(left)
        elif name == "mixing":
            taken = {r.doc_id: r for r in mixing.mix(docs).collect()}
            assert got == Counter({i: n for i, r in taken.items() if r["size"] and (n := int(r.taken / r["size"] + 0.5))})
        else:
            assert set(got) == set(ids)
            words = Counter()
            for r in after:
                words[r.sequence_id] += r.length
            assert max(words.values()) <= packing.CAPACITY and sum(words.values()) == sum(r.length for r in after)
        docs = out
    assert all(after < before for name, before, after in seen[:3]), seen


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_hard_rows(spark):
    """Nulls in every column, empty texts, repeated rows, extra columns with clashing names, and an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    columns = docs.columns
    clash = {c: F.lit(i) for i, c in enumerate(("times", "mixed_id", "mixed_slot", "kept_sha", "kept_nth", "kept_id", "node", "row", "label"))}
    none = spark.createDataFrame([(None,) * len(columns), (7001, None, *[None] * (len(columns) - 2)), (7002, "", *[None] * (len(columns) - 2))], docs.schema)
    hard = docs.unionByName(none).unionByName(none).unionByName(docs.filter("doc_id % 3 = 0")).withColumns(clash)
    for table in (hard, hard.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = written(stage(spark, table, SF))
            assert table.columns == hard.columns
            assert table.count() == 0 or table.agg(*[F.min(c) == i for i, c in enumerate(clash)]).first() == (True,) * len(clash)
        packed = corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in table.collect()}


def test_run_deletes_what_it_wrote(spark):
    folder = Path(shared_folder(spark))
    before = set(folder.iterdir())
    assert corpus_pipeline.run(spark, SF).count()
    assert len(set(folder.iterdir()) - before) == len(corpus_pipeline.STAGES)
