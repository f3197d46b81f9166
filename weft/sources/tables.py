"""The benchmark tables as one graph.

A node's id is its label's tag times 2**40 plus the key. Edge ids are made alike, except those of CONTAINS: line items
have no key, so theirs are 61 bits of the hash of all their values, above all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.sources.graph import Graph

SHIFT = 40
#: All ids are below these.
NODES, EDGES = 10 << SHIFT, (1 << 62) + (1 << 61)
_NODES = {"Region": (1, "region", "r_regionkey", "r_"), "Nation": (2, "nation", "n_nationkey", "n_"), "Customer": (3, "customer", "c_custkey", "c_"), "Supplier": (4, "supplier", "s_suppkey", "s_"), "Part": (5, "part", "p_partkey", "p_"), "Order": (6, "orders", "o_orderkey", "o_")}


def _id(tag: int, key: Column) -> Column:
    return key.cast("bigint") + F.lit(tag << SHIFT)


def tables_graph(spark: SparkSession, sf_dir: str) -> Graph:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    g = Graph(spark)
    for label, (tag, name, key, prefix) in _NODES.items():
        df = read(name)
        g = g.add_nodes(df.select(_id(tag, F.col(key)).alias("id"), *[F.col(c).alias(c.removeprefix(prefix)) for c in df.columns]), [label], below=NODES)
    events, talk = read("events"), read("conversations")
    g = g.add_nodes(events.select("user_id").distinct().select(_id(7, F.col("user_id")).alias("id"), F.col("user_id").alias("uid")), ["User"], below=NODES)
    place = F.col("conv_id") * 1000 + F.col("turn")
    g = g.add_nodes(talk.select(_id(8, place).alias("id"), F.col("conv_id").alias("conv"), "turn", "role"), ["Turn"], below=NODES)
    g = g.add_nodes(events.select(_id(9, F.col("event_id")).alias("id"), "ts", F.col("event_type").alias("type"), "value"), ["Event"], below=NODES)

    def edges(g: Graph, df: DataFrame, kind: str, ident: Column, src: Column, dst: Column, a: list[str], b: list[str], *props: Column) -> Graph:
        return g.add_edges(df.select(ident.alias("id"), src.alias("src"), dst.alias("dst"), *props), kind, src_labels=[[x] for x in a], dst_labels=[[x] for x in b], below=EDGES, check=False)

    g = edges(g, read("nation"), "IN_REGION", _id(1, F.col("n_nationkey")), _id(2, F.col("n_nationkey")), _id(1, F.col("n_regionkey")), ["Nation"], ["Region"])
    g = edges(g, read("customer"), "IN_NATION", _id(2, F.col("c_custkey")), _id(3, F.col("c_custkey")), _id(2, F.col("c_nationkey")), ["Customer"], ["Nation"])
    g = edges(g, read("supplier"), "IN_NATION", _id(3, F.col("s_suppkey")), _id(4, F.col("s_suppkey")), _id(2, F.col("s_nationkey")), ["Supplier"], ["Nation"])
    g = edges(g, read("orders"), "PLACED", _id(4, F.col("o_orderkey")), _id(3, F.col("o_custkey")), _id(6, F.col("o_orderkey")), ["Customer"], ["Order"])
    items = read("lineitem")
    props = [F.col(c).alias(c.removeprefix("l_")) for c in items.columns if c not in ("l_orderkey", "l_partkey")]
    g = edges(g, items, "CONTAINS", F.xxhash64(*sorted(items.columns)).bitwiseAND((1 << 61) - 1) + F.lit(1 << 62), _id(6, F.col("l_orderkey")), _id(5, F.col("l_partkey")), ["Order"], ["Part"], *props)
    g = edges(g, events, "DID", _id(6, F.col("event_id")), _id(7, F.col("user_id")), _id(9, F.col("event_id")), ["User"], ["Event"])
    follow = talk.select("conv_id", "turn").join(talk.select(F.col("conv_id").alias("c2"), (F.col("turn") - 1).alias("t2")), (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2")), "left_semi")
    return edges(g, follow, "NEXT", _id(7, place), _id(8, place), _id(8, place + 1), ["Turn"], ["Turn"])
