"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.llm.common import saved


def _towards_lowest(edges: DataFrame, larger: bool) -> DataFrame:
    """Link the neighbours of every node to the lowest of them; ``larger`` picks which ones move."""
    if larger:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    joined = both.join(lowest, "a")
    moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
    if larger:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = moved.union(lowest.select("a", F.col("low").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``(a, b)``: the lowest node that can be reached.

    The rounds grow with the logarithm of the longest path. Only counts and checksums reach the driver,
    and every round is written out, so that lost executors do not undo earlier ones.
    """
    edges = saved(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    sums = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
    before = edges.agg(*sums).first()
    while before["n"]:
        edges = saved(_towards_lowest(_towards_lowest(edges, True), False), "edges")
        after = edges.agg(*sums).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
