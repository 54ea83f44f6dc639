"""Exact dedup: tree-merge of sorted digest runs."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm.common import join_counted, lower_ascii, releasing, shuffle_partitions, split_by_suspicion, table, unused, written

#: Digest bits settled by one round of exchanges: runs of 2**BITS nodes are merged at a time.
BITS = 3
#: Distinct digests that one node is meant to hold at the end.
NODE_ROWS = 1 << 17
#: Rows that a partition sorts at a time: each such part is a run, and starts at a node of its own.
RUN_ROWS = 1 << 19
#: Rows that are handed on at a time.
BATCH_ROWS = 1 << 14
RUN = ("digest", "n_bytes", "check")
MERGED = "node bigint, run bigint, digest binary, n_bytes int, check bigint, keep_id bigint, members bigint"


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, SHA-256 of the text with A-Z lower-cased, and a second, independent check
    (length in bytes and XXH64) by which runs verify that equal digests are equal texts. A null text is empty."""
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
        "id",
        F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"),
        F.octet_length("t").alias("n_bytes"),
        F.xxhash64("t").alias("check"),
    )


def merge_runs(runs: DataFrame, rows: int, keep: str = "min") -> DataFrame:
    """Merges the digest runs of all partitions: (digest, n_bytes, check, keep_id, members), one row per text.

    Every partition first makes sorted runs of its own, one row per digest. Then nodes exchange runs in rounds, as
    in recursive halving: in round r a node passes on the rows whose digest differs from its own number in the
    round's bits, and merges what its 2**BITS - 1 partners send with its own. The exchange brings each run back into
    its order, and the node merges its runs through a heap into one. After the last round each node alone holds the
    digests that its number stands for. Every merge keeps the smallest (or largest) id of a verified digest and
    the number of members, so that a text with any number of copies is one row per run from the start.
    """
    rounds = max(2, math.ceil(math.log2(max(1, rows / NODE_ROWS) + 1) / BITS))
    width = shuffle_partitions(runs.sparkSession)
    place = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("bigint")
    merged = runs.mapInArrow(partial(_sorted_runs, keep=keep), MERGED)
    merged = merged.withColumn("node", F.pmod(F.xxhash64("run"), F.lit(1 << BITS * rounds)))
    for r in range(rounds):
        mask = ((1 << BITS) - 1) << BITS * r
        merged = (
            merged.withColumn("node", F.col("node").bitwiseAND(~mask).bitwiseOR(place.bitwiseAND(mask)))
            .repartition(width, "node")
            .sortWithinPartitions("node", "run", *RUN)
            .mapInArrow(partial(_merged_nodes, keep=keep), MERGED)
        )
    return merged.drop("node", "run")


@releasing
def _sorted_runs(batches, keep: str):
    """The sorted runs of one partition, numbered by it; of more than RUN_ROWS rows, several."""
    held, rows, run = [], 0, TaskContext.get().partitionId() << 20
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= RUN_ROWS:
            yield from _run(held, run, keep)
            held, rows, run = [], 0, run + 1
    if held:
        yield from _run(held, run, keep)


def _run(held: list, run: int, keep: str):
    own = pa.Table.from_batches(held).group_by(list(RUN)).aggregate([("id", keep), ("id", "count", pc.CountOptions(mode="all"))])
    own = own.rename_columns({f"id_{keep}": "keep_id", "id_count": "members"}).select([*RUN, "keep_id", "members"])
    own = own.sort_by([(c, "ascending") for c in RUN])
    number = pa.array([run], pa.int64()).take(pa.array([0] * own.num_rows, pa.int64()))
    own = own.add_column(0, "run", number).add_column(0, "node", number)
    yield from own.combine_chunks().to_batches(max_chunksize=BATCH_ROWS)


Row = tuple[bytes, int, int, int | None, int]


def merge_sorted(runs: Iterable[Iterator[Row]], keep: str = "min") -> Iterator[Row]:
    """Multiway merge of sorted runs of (digest, n_bytes, check, keep_id, members) into one, with a row for each
    (digest, n_bytes, check): equal digests whose length or check differ are different texts and stay apart."""
    pick = min if keep == "min" else max
    for key, own in groupby(heapq.merge(*runs, key=lambda r: r[:3]), key=lambda r: r[:3]):
        best, members = None, 0
        for r in own:
            best = r[3] if best is None else best if r[3] is None else pick(best, r[3])
            members += r[4]
        yield (*key, best, members)


@releasing
def _merged_nodes(batches, keep: str):
    """Merges the runs of each node in turn; rows come by node, run and digest. One node's runs are held at a time, as
    Arrow columns: about 2**BITS * NODE_ROWS rows."""
    names, columns, count = [c.split()[0] for c in MERGED.split(", ")], [[] for _ in range(7)], 0
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def done():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def rows(parts: list[pa.RecordBatch]) -> Iterator[Row]:
        for part in parts:
            for at in range(0, part.num_rows, 1024):
                some = part.slice(at, 1024)
                yield from zip(*(some.column(k).to_pylist() for k in range(2, 7)), strict=True)

    for node, runs in _runs_by_node(batches):
        for row in merge_sorted([rows(parts) for parts in runs], keep):
            for column, value in zip(columns, (node, node, *row), strict=True):
                column.append(value)
            count += 1
            if count == BATCH_ROWS:
                yield done()
                columns, count = [[] for _ in range(7)], 0
    if count:
        yield done()


def _runs_by_node(batches) -> Iterator[tuple[int, list[list[pa.RecordBatch]]]]:
    """(node, its runs), each run a list of batches."""

    def parts():
        for batch in batches:
            node, run = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *((node[1:] != node[:-1]) | (run[1:] != run[:-1])).nonzero()[0] + 1, batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    yield int(node[a]), int(run[a]), batch.slice(a, b - a)

    for node, own in groupby(parts(), key=lambda p: p[0]):
        yield node, [[part for _, _, part in same] for _, same in groupby(own, key=lambda p: p[1])]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only. The row with the smallest (keep="max": largest) id
    of equal texts is kept. A null text equals an empty one. Null ids lose against any other id; a group of null
    ids alone has a null keep_id. Of rows that repeat an id and a text, one is kept. An empty table gives none.
    Other columns are ignored.
    """
    digests = written(digest_table(docs, id_col, text_col))
    rows = digests.count()
    groups = written(merge_runs(digests, rows, keep))
    hottest = groups.agg(F.max("members")).first()[0] or 0
    key = F.sha2(F.concat_ws("/", F.hex("digest"), "n_bytes", "check"), 256)  # one column for all that must agree
    joined = join_counted(digests.withColumn("key", key), groups.select(key.alias("key"), "keep_id", "members"), "key", "members", rows, hottest)
    nth = F.row_number().over(Window.partitionBy("key", "id").orderBy(F.lit(1)))
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("members").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (nth == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """`docs` without exact copies; columns as they were, whatever their names. Rows that are alike in id and text count
    as copies: of those the one whose values hash lowest stays. Null texts are copies of empty ones. Rows whose ids
    don't repeat and are kept, most of them as a rule, are not moved."""
    found = written(exact_dedup(docs, keep=keep))
    suspects = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("kept").alias("all_kept")).filter("n > 1 or not all_kept").select(F.col("doc_id").alias("id"))
    sure, unsure = split_by_suspicion(docs, "doc_id", suspects)
    sha, nth = unused(docs, "kept_sha"), unused(docs, "kept_nth")
    stays = found.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("found_sha"))
    marked = unsure.withColumn(sha, F.sha2(lower_ascii(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256))
    both = marked.join(stays, marked["doc_id"].eqNullSafe(stays["kept_id"]) & (marked[sha] == stays["found_sha"]), "left_semi")
    order = F.row_number().over(Window.partitionBy(sha, "doc_id").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    return sure.unionByName(both.withColumn(nth, order).filter(F.col(nth) == 1).drop(nth, sha))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


OP9_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
