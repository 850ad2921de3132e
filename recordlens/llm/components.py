"""Distributed connected components in DataFrame operations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import discard, staged


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int | None = None) -> DataFrame:
    """(node, root) of each node that has an edge; root is the smallest node of its component.

    Alternates large-star and small-star steps until no edge changes. Both replace edges by links to
    a neighbourhood's minimum; minima are found by partial aggregation, so a hub costs each task one
    row, and the join that hands them out is left to AQE to split. Null ends and loops are ignored.
    ``most`` bounds the number of edges, if known.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = staged(_down(e), "edges", most)
    before = _digest(e)
    most = 2 * before[0]
    while True:
        # Large star: every larger neighbour of u links to u's smallest neighbour (or u).
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        minima = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "minima", most)
        large = staged(_down(both.where("v > u").join(minima, "u").select("v", F.col("m").alias("u"))), "large-star", most)
        # Small star: u and its smaller neighbours link to the smallest of them.
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "minima", most)
        joined = large.join(low, "u")
        small = staged(_down(joined.select("v", F.col("m").alias("u")).unionByName(low.select(F.col("u").alias("v"), F.col("m").alias("u")))), "small-star", most)
        discard(e, minima, large, low)
        e, after = small, _digest(small)
        if after == before:
            break
        before = after
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _down(e: DataFrame) -> DataFrame:
    """Distinct edges from the larger end u to the smaller end v."""
    return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _digest(e: DataFrame) -> tuple:
    """Count and two order-free sums of an edge table: equal tables have equal digests."""
    h: Column = F.xxhash64("u", "v")
    return tuple(e.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())
