"""Sharding by a hierarchical weighted hash tree, in Spark expressions only.

The tree has three levels: regions, racks, shards. A document descends from the root: at each level every child draws
-ln(u) / weight, u being a hash of the document's key and the child's path and the weight that of all live shards below
it, and the smallest draw wins, so a child is chosen with a probability in proportion to its weight. Only the children
of the chosen node draw: with 4 regions of 2 racks of 5 shards that is 11 draws, not 40.

Draws of one node's children are independent of all other nodes. If a weight changes, only the draws of that shard, its
rack and its region change: documents move into or out of these, and where both the old and the new place lie in subtrees
whose weights are the same, nothing moves. Within a region whose weight changed, the documents that come or go are spread
over its racks by their own draws. ``grown`` adds a shard in a region of its own, so what moves goes to it alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm._common import quoted, spare, table

SHARDS, OVERHEAD = 40, 16
#: Rows that one numbering group should hold; the number of groups follows from the row count.
NUMBERED = 200_000
#: Equal rows that one task writes out at a time.
RUN = 10_000


@dataclass(frozen=True)
class Leaf:
    shard: int
    rack: int
    region: int
    weight: float = 1.0


def tree(shards: int, per_rack: int = 5, racks_per_region: int = 2) -> list[Leaf]:
    """Equal weights, filled rack by rack."""
    return [Leaf(i, i // per_rack, i // (per_rack * racks_per_region)) for i in range(shards)]


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, alone in a new rack of a new region."""
    return [*leaves, Leaf(max(x.shard for x in leaves) + 1, max(x.rack for x in leaves) + 1, max(x.region for x in leaves) + 1, weight)]


_CHILD = "array<array<struct<path:string,weight:double,name:int,node:int>>>"


def _levels(leaves: list[Leaf]) -> list[Column]:
    """For each level an array: node -> its children, each with its path, total weight, name, and node number below."""
    paths = [(x.region, x.rack, x.shard) for x in leaves]
    out, nodes = [], [()]
    for depth in (1, 2, 3):
        below = sorted({p[:depth] for p in paths})
        weight = {q: float(sum(x.weight for x, p in zip(leaves, paths, strict=True) if p[:depth] == q)) for q in below}
        child = lambda q: F.struct(F.lit("/".join(map(str, q))), F.lit(weight[q]), F.lit(q[-1]), F.lit(below.index(q)))  # noqa: B023, E731
        out.append(F.array(*[F.array(*[child(q) for q in below if q[:-1] == node]) for node in nodes]).cast(_CHILD))
        nodes = below
    return out


def _winner(key: Column, children: Column) -> Column:
    """The child with the smallest draw."""

    def draw(c: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, c["path"]), 11).cast("double") + 0.5) * 2.0**-53
        return F.struct((-F.log(u) / c["weight"]).alias("d"), c["name"].alias("name"), c["node"].alias("node"))

    return F.array_min(F.transform(children, draw))


def place(df: DataFrame, key: Column, leaves: list[Leaf], prefix: str = "") -> DataFrame:
    """df with the columns <prefix>region, <prefix>rack and <prefix>shard, which are replaced if df has them.

    Null keys are one key. Weights of zero or less take nothing. Other columns pass through whatever their names.
    """
    live = [x for x in leaves if x.weight > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    names = [f"{prefix}{x}" for x in ("region", "rack", "shard")]
    text, region, rack, shard = spare(df, "weft_key", "weft_region", "weft_rack", "weft_shard")
    regions, racks, shards = _levels(live)
    level = df.withColumn(text, F.coalesce(key.cast("string"), F.lit("null")))
    level = level.withColumn(region, _winner(F.col(text), F.get(regions, F.lit(0))))
    level = level.withColumn(rack, _winner(F.col(text), F.get(racks, F.col(region)["node"])))
    level = level.withColumn(shard, _winner(F.col(text), F.get(shards, F.col(rack)["node"])))
    return level.select(*quoted([c for c in df.columns if c not in names]), *[F.col(c)["name"].alias(n) for c, n in zip((region, rack, shard), names, strict=True)])


def numbered(df: DataFrame, shard: str, rows: int, out: str = "slot") -> DataFrame:
    """df with gapless numbers from 0 within each shard, in as many groups a shard as the row count asks for.

    Numbers follow a hash of the columns, then the columns. Equal rows are interchangeable, so they are counted first,
    numbered as one and written out again in runs: a row that repeats without end is no more work for a task than others.
    """
    columns, (n, g, r, start, run) = df.columns, spare(df, "weft_n", "weft_g", "weft_r", "weft_start", "weft_run")
    groups = max(1, -(-rows // NUMBERED))
    distinct = df.groupBy(*quoted(columns)).agg(F.count(F.lit(1)).alias(n)).withColumn(g, F.pmod(F.xxhash64(*quoted(columns)), F.lit(groups)).cast("int"))
    counts = distinct.groupBy(F.col(f"`{shard}`"), g).agg(F.sum(n).alias(n))
    before = Window.partitionBy(F.col(f"`{shard}`")).orderBy(g).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(f"`{shard}`"), g, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(F.col(f"`{shard}`"), g).orderBy(*quoted(columns)).rowsBetween(Window.unboundedPreceding, -1)
    ranked = distinct.withColumn(r, F.coalesce(F.sum(n).over(within), F.lit(0))).join(starts, [shard, g])
    first = F.col(start) + F.col(r)
    runs = ranked.select(*quoted(columns), (first + F.col(n)).alias(n), F.explode(F.sequence(first, first + F.col(n) - 1, F.lit(RUN).cast("long"))).alias(run))
    return runs.select(*quoted([c for c in columns if c != out]), F.explode(F.sequence(F.col(run), F.least(F.col(run) + RUN, F.col(n)) - 1)).alias(out))


def shard_documents(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, region, rack, shard, grown_shard, slot), one row for each row of df.

    Law ``key``: the id and the tree decide the shard; grown_shard is the place in the tree with one more shard. Null ids
    share one key and with it one shard; a null text has size 16 and the checksum 0 of no bytes. Repeated rows get slots
    of their own. Other columns aren't read. An empty table gives no rows.
    """
    rows = df.count()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    leaves = tree(shards)
    placed = place(place(base, F.col("doc_id"), grown(leaves), "grown_").drop("grown_region", "grown_rack"), F.col("doc_id"), leaves)
    return numbered(placed, "shard", rows)


def op8_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents; null texts have size 16, null ids one shard, equal rows slots of their own."""
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")
