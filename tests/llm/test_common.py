"""The shared folder and scopes."""

from types import SimpleNamespace

import pyarrow as pa
import pytest
from wordloom.llm import common, quality, shingle_dedup, simhash


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: folder or other), sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_shared_folder():
    assert common.shared_folder(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_folder(session("local[2]")) == common.shared_folder(session("local[4]"))
    for master in ("yarn", "spark://a:1", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_folder(session(master))


def test_scope_deletes_its_tables(spark):
    kept = common.written(spark.range(3))
    with common.scope():
        gone, lasting = common.written(spark.range(4)), common.written(spark.range(5), lasting=True)
        assert gone.count() == 4
    assert kept.count() == 3 and lasting.count() == 5
    with pytest.raises(Exception):
        gone.count()


@pytest.mark.parametrize("bits", [common.FILTER_BITS, 1 << 15])
def test_split_by_suspicion(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    ids = [*range(3000), None, -7, 5]
    docs = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id bigint, filter_map string")
    suspects = {*range(0, 3000, 9), None}
    sure, unsure = common.split_by_suspicion(docs, "doc_id", spark.createDataFrame([(i,) for i in suspects], "id bigint"))
    assert sure.columns == unsure.columns == docs.columns
    sure, unsure = ([r.doc_id for r in part.collect()] for part in (sure, unsure))
    assert sorted(map(str, sure + unsure)) == sorted(map(str, ids))
    assert not suspects & set(sure) and len(unsure) < (360 if bits > 1 << 15 else 1000)


def test_keep_one_each(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (None, "e"), (None, "f"), (4, "g")], "doc_id bigint, kept_nth string")
    got = common.keep_one_each(docs, spark.createDataFrame([(1,), (2,), (None,)], "id bigint")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "None"]
    assert common.keep_one_each(docs, spark.createDataFrame([], "id bigint")).collect() == []


@pytest.mark.parametrize("task", [lambda b: simhash._fingerprints(b, 3), lambda b: shingle_dedup._sketches(b, 5), lambda b: shingle_dedup._sets(b, 5), quality._features_of], ids=["fingerprints", "sketches", "sets", "features"])
def test_tasks_give_memory_back_at_their_end(monkeypatch, task):
    """A worker is used again by other stages: what it holds when idle adds to theirs."""
    given = []
    monkeypatch.setattr(common, "release_memory", lambda: given.append(len(seen)))
    seen, batch = [], pa.RecordBatch.from_pydict({"id": [1, 2], "text": ["a b c d e f", None], "quality": pa.array([1, 0], pa.int32())})
    for found in task(iter([batch, batch])):
        seen.append(found.num_rows)
        assert not given
    assert seen == [2, 2] and given == [2]
