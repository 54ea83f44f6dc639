"""SimHash near-dedup: fingerprints, searched for close pairs through vantage-point trees."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import hashed_sample, join_counted, keep_one_each, releasing, shuffle_partitions, table, written
from wordloom.llm.components import components

#: Fingerprints link at so many differing bits or fewer.
RADIUS = 3
#: Words of a shingle.
SHINGLE = 3
#: Fingerprints that a leaf of a vantage-point tree is meant to hold.
LEAF_ROWS = 4096
#: The trees' vantage points and radii are fitted on at most so many fingerprints; all are indexed.
SAMPLE_ROWS = 1 << 16
#: Levels fitted on a sample: 16 of its points for each leaf. Further levels, as many as the rows need, have drawn vantage
#: points and the radius that halves random points.
DEPTH = 12
MEDIAN_RADIUS = 15
#: Shingles hashed at a time, and pairs of a leaf compared at a time.
BLOCK = 1 << 15
PAIR_BLOCK = 1 << 21


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included; A-Z count as a-z. Without words: 0.

    Fewer words than a shingle has make one shingle of all of them.
    """
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: touches A-Z and splits at the six blanks only
    if not words:
        return 0
    flat, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        hashes = np.array([digest(flat[a:b], 42) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


@releasing
def _fingerprints(batches, shingle: int):
    for batch in batches:
        found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    return docs.select(id_col, text_col).mapInArrow(partial(_fingerprints, shingle=shingle), "id bigint, fp bigint")


# A pair within RADIUS bits is within RADIUS // 2 bits in one half of the fingerprint at least. So each half gets a
# tree of its own, searched with that smaller radius: far fewer points lie near a boundary than with all 64 bits.


def half(fp: np.ndarray, which: int) -> np.ndarray:
    return ((fp.view(np.uint64) >> np.uint64(32 * which)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def fit_tree(points: np.ndarray, depth: int, seed: int, reach: int = RADIUS // 2) -> list[tuple[int, int]]:
    """Vantage point and radius of each inner node, in heap order (node 1 is the root; its children are 2 and 3).

    Points within the radius go to the left child. The vantage point is, of a few candidates, the one whose
    distances have the widest spread; the radius splits the points where the larger side, with the band that has
    to be searched on both sides, becomes smallest.
    """
    rng = np.random.default_rng(seed)
    tree: list[tuple[int, int]] = [(0, 0)] * (1 << depth)

    def split(node: int, own: np.ndarray) -> None:
        if node >= len(tree):
            return
        tries = rng.integers(0, 1 << 32, 4, dtype=np.uint32)
        if len(own):
            tries = np.concatenate([tries, rng.choice(own, 4)])
        best = None
        for v in tries:
            d = np.bitwise_count(own ^ v) if len(own) else np.array([16], np.uint8)
            counts = np.bincount(d, minlength=33)
            inner = np.cumsum(counts)
            band = np.convolve(counts, np.ones(reach, int))[:33] if reach else np.zeros(33, int)
            cost = inner.astype(float) ** 2 + (len(d) - inner + band).astype(float) ** 2
            r = int(cost.argmin())
            if best is None or cost[r] < best[0]:
                best = cost[r], int(v), r, d
        _, v, r, d = best
        tree[node] = (v, r)
        split(2 * node, own[d[: len(own)] <= r])
        split(2 * node + 1, own[d[: len(own)] > r])

    split(1, points)
    return tree


def drawn(node: np.ndarray) -> np.ndarray:
    """Vantage points of nodes, drawn by their number alone (splitmix64)."""
    x = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def route(halves: np.ndarray, tree: list[tuple[int, int]], radius: int, visits: np.ndarray | None = None, depth: int = 0, root: int = 1):
    """(row, leaf, visits): the home leaf of every point, and leaves that it visits as its ball crosses a boundary.

    visits: points that have been visitors from the start. depth: levels in all, if more than `tree` has; root: the
    number of the node to begin with, below which vantage points are drawn if `tree` is empty.

    If two points are parted by a node, the one inside is at most the radius from the sphere (the triangle
    inequality bounds what the vantage point sees), so it is enough that inner points visit the outer side.
    """
    row, node = np.arange(len(halves)), np.full(len(halves), root, np.int64)
    visits = np.zeros(len(halves), bool) if visits is None else visits
    vs, rs = np.array([v for v, _ in tree], np.uint32), np.array([r for _, r in tree], np.int64)
    fitted = (len(tree) - 1).bit_length() if len(tree) > 1 else 0
    for level in range(max(fitted, depth)):
        known = level < fitted
        d = np.bitwise_count(halves[row] ^ (vs[node] if known else drawn(node))).astype(np.int64)
        r = rs[node] if known else MEDIAN_RADIUS
        inside, near = d <= r, (d <= r) & (d > r - radius)
        # a visitor on the inner side goes along too, and one on the outer side may have partners inside
        back = visits & (d > r) & (d <= r + radius)
        row, visits, node = (
            np.concatenate([row, row[near], row[back]]),
            np.concatenate([visits, np.ones(near.sum() + back.sum(), bool)]),
            np.concatenate([2 * node + ~inside, 2 * node[near] + 1, 2 * node[back]]),
        )
    return row, node, visits


@releasing
def _routed(batches, trees, depth: int):
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for which, tree in enumerate(trees):
            row, leaf, visits = route(half(fp, which), tree, RADIUS // 2, depth=depth)
            yield pa.RecordBatch.from_arrays(
                [pa.array(2 * leaf + which), pa.array(fp[row]), pa.array(visits)], names=["leaf", "fp", "visits"]
            )


@releasing
def _split_further(batches):
    """Rows (leaf, fp, visits, home) of leaves that hold too much, dealt out by the other half of the bits, within the
    whole radius: points that are alike in one half are spread by the other."""
    for batch in batches:
        leaf, fp, visits, home = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        order = np.lexsort((leaf, home))
        cuts = np.flatnonzero((leaf[order][1:] != leaf[order][:-1]) | (home[order][1:] != home[order][:-1])) + 1
        for own in np.split(order, cuts):
            if not len(own):
                continue
            which = int(leaf[own[0]]) % 2
            deep = split_depth(int(home[own[0]]))
            row, part, again = route(half(fp[own], 1 - which), [], RADIUS, visits[own], deep, int(leaf[own[0]]))
            # numbers of parts end in the half that they were dealt out by first, and are below 0
            yield pa.RecordBatch.from_arrays([pa.array(-(2 * part + which) - 1), pa.array(fp[own][row]), pa.array(again)], names=["leaf", "fp", "visits"])


def split_depth(home: int) -> int:
    return max(0, math.ceil(math.log2(home / LEAF_ROWS)))


def close_links(fp: np.ndarray, visits: np.ndarray, which: int, reach: int = RADIUS // 2) -> tuple[np.ndarray, np.ndarray]:
    """Links (each point, the first point of its set) that join the points of a leaf within RADIUS bits in all and
    `reach` bits in one half.

    Points at home are ordered by their distance from a vantage point in the leaf; by the triangle inequality a
    point can only be near those at almost the same distance. All pairs in reach are compared, in blocks; pairs
    already in one set leave nothing behind, so that a leaf never has more links than points.
    """
    home = fp[~visits]
    points = np.concatenate([home, fp[visits]])
    if len(home) == 0 or len(points) < 2:
        return fp[:0], fp[:0]
    halves = half(points, which)
    d = np.bitwise_count(halves ^ halves[0]).astype(np.int64)
    order = np.concatenate([np.argsort(d[: len(home)], kind="stable"), np.arange(len(home), len(points))])
    points, d = points[order].view(np.uint64), d[order]
    ranks, n = d[: len(home)], len(home)
    sets = np.arange(len(points))

    def find(x: int) -> int:
        while sets[x] != x:
            sets[x] = sets[sets[x]]
            x = sets[x]
        return x

    for value in np.unique(d):
        own = np.flatnonzero(d == value)
        low, high = np.searchsorted(ranks, value - reach, "left"), np.searchsorted(ranks, value + reach, "right")
        if high <= low:
            continue
        step = max(1, PAIR_BLOCK // int(high - low))
        for at in range(0, len(own), step):
            mine = own[at : at + step]
            a, b = np.nonzero(np.bitwise_count(points[mine, None] ^ points[None, low:high]) <= RADIUS)
            a, b = mine[a], b + low
            apart = (a != b) & (sets[a] != sets[b])
            pairs = np.unique(np.stack([sets[a[apart]], sets[b[apart]]], 1), axis=0) if apart.any() else ()
            for x, y in pairs:
                x, y = find(x), find(y)
                if x != y:
                    sets[max(x, y)] = min(x, y)
            if len(pairs):
                while not np.array_equal(flat := sets[sets], sets):
                    sets = flat
    tied = np.flatnonzero(sets != np.arange(len(sets)))
    return points[tied].view(np.int64), points[sets[tied]].view(np.int64)


def leaf_links(fp: np.ndarray, visits: np.ndarray, which: int, reach: int = RADIUS // 2, other: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Links of a leaf; one with many times the rows it should have gets further levels of its own first, and parts
    that one half of the bits can't split are split by the other, within the whole radius."""
    home = int((~visits).sum())
    if home <= 4 * LEAF_ROWS:
        return close_links(fp, visits, which, reach)
    halves = half(fp, which)
    own = halves[~visits]
    tree = fit_tree(own[:: max(1, home // SAMPLE_ROWS)], min(DEPTH, split_depth(home)), 31, reach)
    row, leaf, visits = route(halves, tree, reach, visits)
    order = np.argsort(leaf, kind="stable")
    row, leaf, visits = row[order], leaf[order], visits[order]
    found = []
    for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(leaf)) + 1):
        if (~visits[part]).sum() <= 0.9 * home:
            found.append(leaf_links(fp[row[part]], visits[part], which, reach, other))
        elif other:
            found.append(leaf_links(fp[row[part]], visits[part], 1 - which, RADIUS, False))
        else:  # apart in neither half: it is searched as it is
            found.append(close_links(fp[row[part]], visits[part], which, reach))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _leaf_links(key, pdf: pd.DataFrame) -> pd.DataFrame:
    leaf = int(key[0])
    if leaf >= 0:
        a, b = leaf_links(pdf["fp"].to_numpy(), pdf["visits"].to_numpy(), leaf % 2)
    else:  # a part of a leaf, dealt out by the other half
        a, b = leaf_links(pdf["fp"].to_numpy(), pdf["visits"].to_numpy(), 1 - (-leaf - 1) % 2, RADIUS)
    return pd.DataFrame({"a": a, "b": b})


@releasing
def _fitted_trees(batches, depth: int):
    """Both trees of a sample, as one row of bytes."""
    found = [batch.column(0).to_numpy(zero_copy_only=False) for batch in batches]
    sample = np.sort(np.concatenate([np.zeros(0, np.int64), *found]))
    trees = [np.array(fit_tree(half(sample, which), depth, 17 + which), np.int64).tobytes() for which in (0, 1)]
    yield pa.RecordBatch.from_arrays([pa.array([t], pa.binary()) for t in trees], names=["low", "high"])


def link_fingerprints(distinct: DataFrame, rows: int) -> DataFrame:
    """Links (a, b) between fingerprints that join all within RADIUS bits; `distinct` has a column fp without repeats.

    The upper levels of a vantage-point tree for each half of the bits are fitted on a bounded sample, in one task;
    levels below them have drawn vantage points, as many as the rows need. They deal all fingerprints out to leaves, and
    each leaf is searched on its own, with the points beside its boundaries as visitors. Leaves that still hold many
    times what they should, as where very many fingerprints agree in one half, are dealt out anew by the other half.
    """
    spark = distinct.sparkSession
    depth = max(0, math.ceil(math.log2(max(1, rows) / LEAF_ROWS)))
    trees = [[(0, 0)], [(0, 0)]]
    if depth:
        fitted = hashed_sample(distinct.select("fp"), "fp", rows, SAMPLE_ROWS).repartition(1).mapInArrow(partial(_fitted_trees, depth=min(DEPTH, depth)), "low binary, high binary").first()
        trees = [[tuple(x) for x in np.frombuffer(t, np.int64).reshape(-1, 2).tolist()] for t in fitted]
    routed = distinct.select("fp").mapInArrow(partial(_routed, trees=trees, depth=depth), "leaf bigint, fp bigint, visits boolean")
    if depth:
        routed = written(routed)
        sizes = routed.groupBy("leaf").agg(F.count_if(~F.col("visits")).alias("home"), F.count(F.lit(1)).alias("n")).filter(F.col("home") > 4 * LEAF_ROWS)
        large = written(sizes)
        if not large.isEmpty():
            rest = routed.join(large.select("leaf"), "leaf", "left_anti")
            of_large = join_counted(routed, large, "leaf", "n", routed.count()).select("leaf", "fp", "visits", "home")
            routed = written(rest.unionByName(of_large.mapInArrow(_split_further, "leaf bigint, fp bigint, visits boolean")))
    width = max(shuffle_partitions(spark), min(1 << 15, 2 << depth))
    return routed.repartition(width, "leaf").groupBy("leaf").applyInPandas(_leaf_links, "a bigint, b bigint")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of `docs`: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id that can be reached over fingerprints at most RADIUS bits apart. Null and empty
    texts have fingerprint 0 and link as any other. Null ids never become a component_id unless all of a component
    are null. Repeated rows get a row each; an empty table gives none. Other columns are ignored.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle))
    rows = prints.count()
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("members")))
    links = link_fingerprints(distinct, distinct.count())
    roots = components(links)  # (node, root) of the fingerprints that have links
    placed = distinct.join(roots.hint("merge"), distinct["fp"] == roots["node"], "left").select("fp", "least", "members", F.coalesce("root", "fp").alias("root"))
    placed = written(placed)
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    # most fingerprints are alone: only the others need a join with their component's smallest id
    total = placed.count()
    of_print = join_counted(placed.select("fp", "members", "root"), least, "root", "prints", total).select("fp", "members", "component_id")
    return join_counted(prints, of_print, "fp", "members", rows).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def leading_ids(components_: DataFrame) -> DataFrame:
    """The ids (a column `id`) that lead their components, of (doc_id, component_id)."""
    return components_.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id")).distinct()


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component of near_dedup, that of its component_id; columns as they were.

    Rows without words are one component. Rows of null ids stay if their component has no other ids; of those and of
    rows that repeat an id, one stays. An empty table gives none.
    """
    return keep_one_each(docs, written(leading_ids(near_dedup(docs))))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
