"""Near copies by word shingles: MinHash bands give candidates, and the Jaccard similarity of the shingle sets decides."""

from __future__ import annotations

from functools import partial
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import join_counted, keep_one_each, releasing, shuffle_partitions, split_by_suspicion, written
from wordloom.llm.components import components
from wordloom.llm.simhash import leading_ids

#: Words of a shingle, and the least Jaccard similarity of near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Pairs of similarity s meet with probability 1 - (1 - s ** ROWS) ** BANDS: 0.999997 for 0.8, more above.
BANDS, ROWS = 24, 4
#: Shingles that are hashed at a time.
BLOCK = 1 << 12
#: Nodes of a band, and bytes of their sets, that are compared with as many others in one task, by their signatures; those
#: that agree in less than PROMISING of it are far below SIMILARITY (five standard deviations).
TILE, TILE_BYTES, PROMISING = 1024, 1 << 25, 0.6
#: The signature's hash functions are x * odd + number, modulo 2 ** 64.
TIMES, PLUS = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
TIMES |= np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different word shingles, of all words if they are fewer; A-Z count as a-z."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: touches A-Z and splits at the six blanks only
    if not words:
        return np.zeros(0, np.uint64)
    flat, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(flat[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def bands(own: np.ndarray) -> tuple[list[int], bytes]:
    """A key for each band of the set's MinHash signature, and 16 bits of each value of it; none for an empty set."""
    import xxhash

    if not len(own):
        return [], b""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), BLOCK):
        least = np.minimum(least, (own[None, at : at + BLOCK] * TIMES + PLUS).min(axis=1))
    keys = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return keys, (least >> np.uint64(48)).astype(np.uint16).tobytes()


@releasing
def _sketches(batches, shingle: int):
    import xxhash

    for batch in batches:
        sets = [shingle_set(t.as_py(), shingle) for t in batch.column(1)]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
        found = [bands(s) for s in sets]
        keys = [np.array(k, np.uint64).view(np.int64) for k, _ in found]
        columns = [batch.column(0), pa.array(nodes), pa.array(keys, pa.list_(pa.int64())), pa.array([b for _, b in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "keys", "sketch"])


def _tiles(batches):
    """The rows of one tile after the other, as batches; they come sorted by tile, the first three columns."""
    held, before = [], None
    for batch in batches:
        tile = np.stack([batch.column(c).to_numpy() for c in range(3)])
        cuts = [0, *(np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for at, end in pairwise(cuts):
            if at == end:
                continue
            if held and (tile[:, at] != before).any():
                yield held
                held = []
            before = tile[:, at]
            held.append(batch.slice(at, end - at))
    if held:
        yield held


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many values each signature of `a` agrees with each of `b`."""
    if len(a) * len(b) < 512:
        return (a[:, None] == b[None]).sum(axis=2)
    agree, across = np.zeros((len(a), len(b)), np.uint8), np.ascontiguousarray(b.T)
    for k in range(a.shape[1]):
        agree += a[:, k, None] == across[k]
    return agree


class _Overlap:
    """Jaccard similarities of one set with some of the others, all given as bytes of sorted hashes."""

    def __init__(self, sets: list[bytes]):
        self.size = np.array([len(s) // 8 for s in sets])
        self.end = np.cumsum(self.size)
        different, self.code = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
        self.mark = np.zeros(len(different), bool)

    def _codes(self, k: int) -> np.ndarray:
        return self.code[self.end[k] - self.size[k] : self.end[k]]

    def similarities(self, own: int, others: np.ndarray) -> np.ndarray:
        self.mark[self._codes(own)] = True
        both = np.array([np.count_nonzero(self.mark[self._codes(k)]) for k in others.tolist()])
        self.mark[self._codes(own)] = False
        return both / (self.size[own] + self.size[others] - both)


def _pairs_of_tile(i, low: int, high: int, root, sketches: list[bytes], sets: list[bytes] | None, least: float | None):
    """Places (a, b) of pairs in different components whose signatures agree in much; with `least`, only of pairs that are
    that similar, and of these only such as still connect different components."""
    signature, label = np.frombuffer(b"".join(sketches), np.uint16).reshape(len(sketches), -1), np.unique(root, return_inverse=True)[1]
    left, right, overlap = np.flatnonzero(i == low), np.flatnonzero(i == high), None
    left = left[np.argsort(label[left], kind="stable")]
    for at in range(0, len(left), 64):
        rows = left[at : at + 64]
        own = label[rows]
        there = right[label[right] != own[0]] if (own == own[0]).all() else right
        x, y = np.nonzero(_agreement(signature[rows], signature[there]) >= PROMISING * signature.shape[1])
        bounds = np.searchsorted(x, np.arange(len(rows) + 1)).tolist()
        for a, begin, end in zip(rows.tolist(), bounds, bounds[1:], strict=False):
            others = there[y[begin:end]]
            others = others[(label[others] != label[a]) & ((others > a) | (low != high))]
            if least is not None and len(others):
                overlap = overlap or _Overlap(sets)
                others = others[overlap.similarities(a, others) >= least]
                _, first = np.unique(label[others], return_index=True)
                others = others[first]
                label[np.isin(label, label[others])] = label[a]
            if len(others):
                yield a, others


@releasing
def _promising(batches, least: float | None):
    for held in _tiles(batches):
        tile = held[0] if len(held) == 1 else pa.Table.from_batches(held)
        i, node, root = (tile.column(c).to_numpy() for c in (3, 4, 5))
        sets = None if least is None else tile.column(7).to_pylist()
        low, high = (tile.column(c)[0].as_py() for c in (1, 2))
        found = list(_pairs_of_tile(i, low, high, root, tile.column(6).to_pylist(), sets, least))
        if found:
            a, b = (node[np.concatenate(side)] for side in ([np.full(len(o), k) for k, o in found], [o for _, o in found]))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])


def further_pairs(placed: DataFrame, width: int, least: float | None = None) -> DataFrame:
    """(a, b) of nodes that share a band, are in different components and may be alike; placed: (key, node, root, sketch).
    With `least`, placed has `shingles` as well, the bytes of a node's shingle set, and pairs are of that similarity or
    more, as many in a tile as connect its components: no more than it has nodes, however many are alike.

    A band's nodes are dealt into blocks of about TILE nodes and TILE_BYTES, those of its largest component apart from the
    others, and each pair of blocks, but for two of the largest component, is one task's work: a band with very many
    nodes is many tasks, and where most are joined already their sets are moved to few of them.
    """
    content = [c for c in ("sketch", "shingles") if c in placed.columns]
    of_root = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum(sum(F.length(c) for c in content)).alias("bytes"))
    most = F.max(F.struct("n", "root", "bytes"))
    sizes = of_root.groupBy("key").agg(most.alias("most"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))

    def blocks(n, size):
        return F.ceil(F.greatest(n / TILE, size / TILE_BYTES)).cast("int")

    others = blocks(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes"))
    sizes = sizes.filter("n > most.n").select("key", F.col("most.root").alias("main"), "n", others.alias("others"), blocks(F.col("most.n"), F.col("most.bytes")).alias("mains"))
    dealt, main, turn = join_counted(placed, sizes, "key", "n", placed.count()), F.col("root") == F.col("main"), F.xxhash64("node")
    dealt = dealt.withColumn("i", F.when(main, F.col("others") + F.pmod(turn, F.col("mains"))).otherwise(F.pmod(turn, F.col("others"))).cast("int"))
    tiles = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.when(main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)))
    tiles = tiles.select("key", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), "i", "node", "root", *content)
    sorted_ = tiles.repartition(width, "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return sorted_.mapInArrow(partial(_promising, least=least), "a bigint, b bigint").distinct()


@releasing
def _sets(batches, shingle: int):
    for batch in batches:
        sets = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])


@releasing
def _of_node(batches, shingle: int):
    """Rows (node, text) whose text has the node's shingle set: an id that repeats can have others."""
    import xxhash

    for batch in batches:
        own = [xxhash.xxh64_intdigest(shingle_set(t.as_py(), shingle).tobytes(), 7) for t in batch.column(1)]
        yield batch.filter(pc.equal(batch.column(0), pa.array(np.array(own, np.uint64).view(np.int64))))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


@releasing
def _alike(batches, shingle: int, least: float):
    for batch in batches:
        seen = [similarity(shingle_set(a.as_py(), shingle), shingle_set(b.as_py(), shingle)) >= least for a, b in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(seen, pa.bool_())], names=["a", "b", "alike"])


def _checked(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(a, b, alike) of the pairs (a, b); a node with very many pairs is joined by broadcast."""
    total = pairs.count()
    for end in ("a", "b"):
        right = texts.join(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")), texts["node"] == F.col(end)).select(end, F.col("text").alias(f"text_{end}"), "n")
        hottest = pairs.groupBy(end).count().agg(F.max("count")).first()[0] or 0  # known, so that no texts are written for it
        pairs = join_counted(pairs, right, end, "n", total, hottest).drop("n")
    return written(pairs.select("a", "b", "text_a", "text_b").mapInArrow(partial(_alike, shingle=shingle, least=least), "a bigint, b bigint, alike boolean"))


def shingle_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY, among: DataFrame | None = None) -> DataFrame:
    """One row per row of `docs`: id, component_id, the smallest id that can be reached over texts of whose word shingles
    they share `least` or more (Jaccard). among: the ids (a column `id`) that are looked at; all others are left out.

    Rows of one shingle set are one node; rows without words are one as well. A node is first compared with the least
    node of all its bands'. Where this leaves a band's nodes in several components, their signatures are compared in tiles
    (further_pairs), and what agrees in much is compared there by its shingle sets: only links leave a tile, no pairs that
    are yet to be looked at. Only texts of nodes that meet another are moved, one of each. Null ids lose against any other;
    repeated rows get a row each; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(partial(_sketches, shingle=shingle), "id bigint, node bigint, keys array<bigint>, sketch binary")
    rows = written(rows if among is None else rows.join(among.select(F.col("id").alias("_id")), F.col("id").eqNullSafe(F.col("_id")), "left_semi"))
    nodes = written(rows.groupBy("node").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("members"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    met = nodes.select("node", F.explode("keys").alias("key"))
    total = nodes.count() * BANDS
    shared = met.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = written(join_counted(met, shared, "key", "n", total).select("key", "node", "pivot", "n"))
    texts = written(_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shingle, nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "least_id")))
    seen = _checked(written(met.groupBy("node").agg(F.min("pivot").alias("b")).filter("node <> b").select(F.col("node").alias("a"), "b")), texts, shingle, least)
    links = seen.filter("alike").select("a", "b")
    roots = written(components(links))
    placed = written(met.join(roots.hint("merge"), "node", "left").select("key", "node", "pivot", "n", F.coalesce("root", "node").alias("root")))
    apart = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    # bands of two nodes that were compared
    done = placed.filter("n = 2 and node <> pivot").select("key", F.col("node").alias("a"), F.col("pivot").alias("b")).join(seen.select("a", "b").hint("merge"), ["a", "b"], "left_semi").select("key")
    left = written(placed.join(apart.hint("merge"), "key", "left_semi").join(done.hint("merge"), "key", "left_anti").select("key", "node", "root"))
    sets = texts.join(left.select("node").distinct().hint("merge"), "node", "left_semi").mapInArrow(partial(_sets, shingle=shingle), "node bigint, shingles binary")
    left = left.join(nodes.select("node", "sketch").hint("merge"), "node").join(sets.hint("merge"), "node")
    links = links.unionByName(written(further_pairs(written(left), shuffle_partitions(docs.sparkSession), least)))
    roots = components(links)
    placed = written(nodes.select("node", "least_id", "members").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")))
    of_root = placed.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_node = join_counted(placed, of_root, "root", "n", nodes.count()).select("node", "members", "component_id")
    return join_counted(rows.select("id", "node"), of_node, "node", "members", rows.count()).select(F.col("id").alias(id_col), "component_id")


def _texts(docs: DataFrame, shingle: int, wanted: DataFrame) -> DataFrame:
    """(node, text) of the nodes `wanted` (node, least_id), from any row of docs (id, text) that has that id and set; rows
    of other ids, most of them as a rule, are not moved."""
    _, close = split_by_suspicion(docs, "id", wanted.select(F.col("least_id").alias("id")))
    found = close.join(wanted, close["id"].eqNullSafe(wanted["least_id"])).select("node", "text")
    return found.mapInArrow(partial(_of_node, shingle=shingle), "node bigint, text string").groupBy("node").agg(F.first("text").alias("text"))


def drop_near_copies(docs: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """`docs` with one row of each component, that of its component_id; columns as they were. Of rows that repeat that id
    one stays; rows without words are copies of each other; an empty table gives none. among: see shingle_components."""
    return keep_one_each(docs, written(leading_ids(shingle_components(docs, among=among))))
