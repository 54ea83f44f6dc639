"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import join_counted, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b: longs) that has another: root is the least node of its component.

    A round joins each node's larger neighbours, then its smaller ones, to the least neighbour, which ends in stars
    after a number of rounds that grows with the logarithm of the longest path at most. Minima are taken before the
    shuffle, and nodes with very many neighbours are joined by broadcast (join_counted).
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        size, state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if (size, state) == before or not size:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = size, state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to_least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        # large star: (v, least of u) for the larger neighbours v of u
        edges = join_counted(both, to_least, "u", "n", 2 * size).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(edges.distinct())
        # small star: the smaller neighbours of u, and u itself, go to the least of them
        size = edges.count()
        to_least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = join_counted(edges, to_least, "u", "n", size).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(joined.unionByName(to_least.select("u", F.col("m").alias("v"))).distinct())
