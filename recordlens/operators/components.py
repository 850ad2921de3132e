"""Connected components, by alternating star contractions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import drop, written


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of each node with an edge (a, b); the root is its component's smallest node. Loops and null ends are ignored.

    Edges hang from their larger end. One half of a round hangs a node's larger neighbours, the other its smaller ones,
    from the smallest node around it; the rounds end when no edge moves. Smallest neighbours come from partial
    aggregation, so a hub is one row from each task.
    """
    hung = written(_hang(edges.select(F.col("a").alias("low"), F.col("b").alias("high")).where("a <> b")), "edges")
    state = _state(hung)
    while True:
        around = hung.unionByName(hung.select(F.col("low").alias("high"), F.col("high").alias("low"))).select(F.col("high").alias("node"), F.col("low").alias("other"))
        least = around.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root"))
        upper = written(_hang(around.where("other > node").join(least, "node").select(F.col("root").alias("low"), F.col("other").alias("high"))), "upper")
        least = upper.groupBy("high").agg(F.min("low").alias("root"))
        lower = upper.join(least, "high").select(F.col("root").alias("low"), F.col("low").alias("high")).unionByName(least.select(F.col("root").alias("low"), "high"))
        new = written(_hang(lower), "edges")
        drop(hung, upper)
        hung, before, state = new, state, _state(new)
        if state == before:
            break
    return hung.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(hung.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())


def _hang(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")).where("low <> high").distinct()


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    h = F.xxhash64("low", "high")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1_000_003)))).first())
