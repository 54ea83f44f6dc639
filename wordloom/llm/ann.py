"""Approximate nearest neighbours that end exact: a block matrix join over int8 tiles with error bounds."""

from __future__ import annotations

import heapq
import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import shuffle_partitions, table, written

NEIGHBOURS = 20
#: Queries that a task holds at most, in rows and in bytes; candidates of a strip, which a task reads past them, tile by
#: tile, however long the strip is. A query is copied once a strip, a candidate once a block of queries.
QUERY_ROWS, QUERY_BYTES, STRIP_ROWS = 1 << 16, 96 << 20, 1 << 18
#: Cells (a block of queries with a strip) that are made at least, if there are rows for them, so that a cluster has work
#: for all, and rows of a strip that are worth a cell.
LEAST_CELLS, LEAST_ROWS = 48, 256
#: Queries and candidates whose products are held at a time.
TILE_QUERIES, TILE_CANDIDATES = 256, 2048
#: Pairs computed in full at a time.
PAIRS = 1 << 14

FOUND = "query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): vectors that are neither null nor zero and have finite components only, as they are stored: float or double."""
    v, kind = F.col("v"), dict(vectors.dtypes)[vector_col]
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = F.col(vector_col) if kind == "array<float>" else F.col(vector_col).cast("array<double>")
    return vectors.select(F.col(id_col).alias("id"), kept.alias("v")).filter(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


class Tile:
    """Vectors as int8 with a scale each, exact in float32 products; `near` bounds what the rounding lost."""

    def __init__(self, vectors: np.ndarray):
        top = np.abs(vectors).max(axis=1)
        self.scale = np.where(top > 0, top / 127, 1.0)
        codes = np.rint(vectors / self.scale[:, None]).astype(np.int8)
        self.codes = codes.astype(np.float32)  # BLAS has no int8; sums below 2**24 are exact in float32
        kept = codes * self.scale[:, None]
        self.norm = np.sqrt((vectors**2).sum(axis=1))
        self.lost = np.sqrt(((vectors - kept) ** 2).sum(axis=1))

    def bounds(self, other: Tile, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
        """Product of the codes, and how far the product of the vectors can be from it (Cauchy-Schwarz)."""
        if self.codes.shape[1] * 127 * 127 < 1 << 24:
            product = (self.codes[a] @ other.codes[b].T).astype(np.float64)
        else:
            product = self.codes[a].astype(np.float64) @ other.codes[b].astype(np.float64).T
        product *= self.scale[a, None] * other.scale[None, b]
        off = self.lost[a, None] * other.norm[None, b] + (self.norm[a, None] + self.lost[a, None]) * other.lost[None, b]
        return product, off * (1 + 1e-9) + 1e-12 * self.norm[a, None] * other.norm[None, b]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed from the first component to the last."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


class QueryBlock:
    """Queries of one length that candidates are led past, tile by tile; the k nearest so far of each are held."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k, self.tile = ids, vectors, k, Tile(vectors)
        self.floor = np.full(len(ids), -np.inf)  # a score that k candidates reach for sure
        self.held_ids, self.held = [np.zeros(0, np.int64)] * len(ids), [np.zeros(0)] * len(ids)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Where a tile's upper bound reaches what k candidates reach for sure, the product is computed in full. The first
        tile's lower bounds tell that score, later on what is held does."""
        right, k = Tile(vectors), self.k
        cols = slice(0, len(ids))
        for at in range(0, len(self.ids), TILE_QUERIES):
            rows = slice(at, min(at + TILE_QUERIES, len(self.ids)))
            product, off = self.tile.bounds(right, rows, cols)
            own = self.ids[rows, None] == ids[None, :]
            floor = self.floor[rows]
            if len(ids) >= k and np.isneginf(floor).any():
                low = np.where(own, -np.inf, product - off)
                floor = np.maximum(floor, np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k])
            i, j = np.nonzero((product + off >= floor[:, None]) & ~own)
            score = np.concatenate([products(self.vectors[rows][i[p : p + PAIRS]], vectors[j[p : p + PAIRS]]) for p in range(0, len(i), PAIRS)] or [np.zeros(0)])
            cuts = np.searchsorted(i, np.arange(rows.stop - at + 1))
            for q in np.flatnonzero(np.diff(cuts)).tolist():
                mine = slice(cuts[q], cuts[q + 1])
                all_ids, all_scores = np.concatenate([self.held_ids[at + q], ids[j[mine]]]), np.concatenate([self.held[at + q], score[mine]])
                top = best(all_ids, all_scores, k)
                self.held_ids[at + q], self.held[at + q] = all_ids[top], all_scores[top]
                if len(top) == k:
                    self.floor[at + q] = max(floor[q], self.held[at + q][-1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(self.ids, [len(x) for x in self.held_ids]), np.concatenate(self.held_ids), np.concatenate(self.held)


def by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors as one matrix, by number of components."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        flat = pc.list_flatten(column.take(pa.array(rows))).to_numpy(zero_copy_only=False)
        out[n] = rows, flat.astype(np.float64).reshape(len(rows), n)
    return out


class Cell:
    """A block of queries, and candidates that wait for a full tile; apart by length."""

    def __init__(self, k: int):
        self.k, self.queries, self.blocks, self.waiting = k, {}, None, {}

    def add_queries(self, ids: np.ndarray, column: pa.Array) -> None:
        for n, (rows, vectors) in by_length(column).items():
            self.queries.setdefault(n, []).append((ids[rows], vectors))

    def add_candidates(self, ids: np.ndarray, column: pa.Array) -> None:
        if self.blocks is None:
            self.blocks = {n: QueryBlock(np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]), self.k) for n, parts in self.queries.items()}
        for n, (rows, vectors) in by_length(column).items():
            if n in self.blocks:
                self.waiting.setdefault(n, []).append((ids[rows], vectors))
                if sum(len(i) for i, _ in self.waiting[n]) >= TILE_CANDIDATES:
                    self.search(n)

    def search(self, n: int) -> None:
        parts = self.waiting.pop(n)
        ids, vectors = np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts])
        for at in range(0, len(ids), TILE_CANDIDATES):
            self.blocks[n].meet(ids[at : at + TILE_CANDIDATES], vectors[at : at + TILE_CANDIDATES])

    def found(self):
        for n in list(self.waiting):
            self.search(n)
        for block in (self.blocks or {}).values():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in block.found()], names=["query_id", "vec_id", "score"])


def _cells(batches, k: int):
    """Rows (cell, side, id, v) come by cell, queries (side 0) first."""
    now, cell = None, Cell(k)
    for batch in batches:
        number, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ids = batch.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero((number[1:] != number[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(number)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b == a:
                continue
            if number[a] != now:
                yield from cell.found()
                now, cell = number[a], Cell(k)
            (cell.add_candidates if side[a] else cell.add_queries)(ids[a:b], batch.column(3).slice(a, b - a))
    yield from cell.found()


def _merged(batches, k: int):
    """A query's best of all cells, through a heap of k. Rows come ordered by query."""
    query, heap = None, []

    def done():
        ordered = sorted(heap, reverse=True)
        return pd.DataFrame({"query_id": query, "rank": range(1, len(ordered) + 1), "vec_id": [-v for _, v in ordered], "score": [s for s, _ in ordered]})

    for pdf in batches:
        out = []
        for q, vec, score in zip(pdf["query_id"].tolist(), pdf["vec_id"].tolist(), pdf["score"].tolist(), strict=True):
            if q != query:
                if heap:
                    out.append(done())
                query, heap = q, []
            if len(heap) < k:
                heapq.heappush(heap, (score, -vec))
            elif (score, -vec) > heap[0]:
                heapq.heapreplace(heap, (score, -vec))
        if out:
            yield pd.concat(out)
    if heap:
        yield done()


def nearest(vectors: DataFrame, queries: str, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for the rows that meet the SQL condition `queries` on their `id`, the k
    rows of largest inner product with other ids, ties to smaller ids; all, if there are fewer.

    Queries are dealt into blocks and candidates into strips; a cell of the grid leads a strip past a block. Vectors null,
    zero or holding null or non-finite components take no part, nor do null ids; of rows that repeat an id the least
    vector, component by component, counts; vectors are compared with those of as many components only. An empty table
    gives none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).filter("id is not null")
    n, distinct, asked, width = rows.select(F.count(F.lit(1)), F.count_distinct("id"), F.count_if(F.expr(queries)), F.max(F.size("v"))).first()
    if distinct < n:
        rows = written(rows.groupBy("id").agg(F.min("v").alias("v")))
    held = max(1, min(QUERY_ROWS, QUERY_BYTES // (12 * max(1, width or 1))))
    blocks = max(1, math.ceil(asked / held))
    strips = max(1, math.ceil(n / STRIP_ROWS), min(math.ceil(LEAST_CELLS / blocks), math.ceil(n / LEAST_ROWS)))

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = rows.filter(queries).select("id", "v", F.lit(0).alias("side"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("q"), every(strips).alias("c"))
    right = rows.select("id", "v", F.lit(1).alias("side"), every(blocks).alias("q"), F.pmod(F.xxhash64("id"), F.lit(strips)).alias("c"))
    cell = (F.col("c") * blocks + F.col("q")).cast("long").alias("cell")
    parts = max(shuffle_partitions(spark), min(blocks * strips, 1 << 15))
    dealt = left.unionByName(right).select(cell, "side", "id", "v").repartition(parts, "cell").sortWithinPartitions("cell", "side", "id")
    found = dealt.mapInArrow(partial(_cells, k=k), FOUND)
    merged = found.repartition("query_id").sortWithinPartitions("query_id")
    return merged.mapInPandas(lambda batches: _merged(batches, k), "query_id bigint, rank int, vec_id bigint, score double")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0")


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda x, y: x + y) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
