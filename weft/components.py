"""Connected components of an edge table, by alternating star contraction, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.checkpointing import cut


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node reachable; nodes without edges are not returned.

    Each round joins every node's edges to its smallest neighbour, first toward larger neighbours, then among smaller
    ones, until the edge set is a forest of stars; the number of rounds grows with the logarithm of the longest chain.
    Hubs only meet in joins on the node, whose large partitions adaptive execution splits. Null ends are dropped.
    """
    edges = edges.select("a", "b").filter("a <> b")
    pairs = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _signature(pairs)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.when(F.col("b") == F.col("m"), F.array(F.struct("a", F.col("m").alias("b")))).otherwise(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).alias("e"))
            .select("e.a", "e.b")
        )
        pairs = cut(small.distinct(), "edges")
        now = _signature(pairs)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # a star's centre is in no first column, and every other node has one edge, to its centre
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
