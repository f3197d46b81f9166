"""Near-duplicate candidates of wide SimHash fingerprints, by tables of their nearest pivots.

Every shingle is hashed to ``WIDTH`` bits. A text's total distance to a reference fingerprint (pivot) is the sum of the
Hamming distances of its shingles' hashes to it; the SimHash fingerprint, a majority of each bit, is the point where that
total is least. As all bits' votes enter a total, it tells more than the fingerprint's own distance to the pivot.

Texts of five-word Jaccard similarity 0.8 differ in 39 of 256 bits on average. By the triangle inequality coordinates of
such texts may differ by as much, and those of unlike texts differ by 11: here it discards nothing. So a text's row of the
pivot table is used by its least entries: ``TABLES`` times ``SETS`` sets of ``2 * WIDTH`` pivots (orthogonal ones and their
complements) are asked for the nearest, and texts meet that have a table's nearest pivots in common. Two texts of similarity
0.8 have one nearest pivot in common with probability 0.38, so they miss each other in all tables with probability 6e-4, and
texts of similarity 0.85 with 2e-5.

Texts that meet are verified by popcounts: at most ``LIMIT`` differing bits, which a pair of similarity 0.8 exceeds with
probability 5e-5 and half of the pairs of similarity 0.57 do. Only spanning edges are emitted.

``class_edges`` takes groups of any size. Larger ones are cut into parts that are searched together with ``HUBS`` members of
the whole group; members that are outside the group's main component then are searched together with all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from weft.checkpointing import cut
from weft.components import connected_components

WIDTH, TABLES, SETS, LIMIT, SEED = 256, 48, 2, 62, 42
#: Members and 64-bit words of a group that one call searches, and members that are searched with each part of a larger one.
GROUP, WORDS, HUBS = 4096, 1 << 21, 64
#: Shingles whose bits are unpacked in one step, so that a text of any length needs little memory.
STEP = 1 << 13
#: Words before a member's own in a list of members: its id, its class and the number of its words.
HEAD = 3
_FACTORS = np.array([xxh64_intdigest(f"wide {i}".encode(), SEED) | 1 for i in range(WIDTH // 64)], np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)

Spanning = Callable[[np.ndarray], list[tuple[int, int]]]


def votes(shingles: np.ndarray) -> np.ndarray:
    """For each of WIDTH bits how many more shingles have it than have it not."""
    ones = np.zeros(WIDTH, np.int64)
    for i in range(0, len(shingles), STEP):
        wide = shingles[i : i + STEP, None] * _FACTORS
        wide = (wide ^ (wide >> np.uint64(31))) * _MIX
        wide ^= wide >> np.uint64(29)
        ones += np.unpackbits(wide.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * ones - len(shingles)


def fingerprint(of: np.ndarray) -> np.ndarray:
    """The majority of each bit, as signed 64-bit words."""
    return np.packbits(of > 0, bitorder="little").view("<i8")


@cache
def pivots(number: int) -> np.ndarray:
    """The pivots of one set, as columns of signs (a bit that is set is 1): a Hadamard matrix, its rows' signs changed by a rule."""
    signs = np.frombuffer(b"".join(xxh64_intdigest(f"pivots {number} {i}".encode(), SEED).to_bytes(8, "little") for i in range(WIDTH // 64)), np.uint8)
    matrix = np.ones((1, 1), np.float32)
    while len(matrix) < WIDTH:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return np.where(np.unpackbits(signs)[:, None] > 0, matrix, -matrix).astype(np.float32)


def nearest(of: np.ndarray, number: int) -> np.ndarray:
    """The number of the nearest pivot of a set for each row of votes; a pivot's complement has its number plus WIDTH.

    A total distance is (WIDTH * shingles - votes . signs) / 2, so the least total is the largest product.
    """
    product = of.astype(np.float32) @ pivots(number)
    at = np.abs(product).argmax(axis=1)
    return at + WIDTH * (product[np.arange(len(at)), at] < 0)


def table_keys(of: np.ndarray) -> np.ndarray:
    """TABLES keys for each row of votes: a table's number and its nearest pivots."""
    keys = np.zeros((len(of), TABLES), np.int64)
    for t in range(TABLES):
        keys[:, t] = t
        for s in range(SETS):
            keys[:, t] = keys[:, t] * 2 * WIDTH + nearest(of, t * SETS + s)
    return keys


def walk(ids: np.ndarray, classes: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges that span the components of a group's graph; members of one class are known to be linked.

    Whatever is reached is never looked at again, so a dense group costs about its size.
    """
    rest, edges = np.arange(len(ids)), []
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            i = stack.pop()
            known = classes[rest] == classes[i]
            stack += list(rest[known])
            rest = rest[~known]
            if len(rest):
                hit = near(i, rest)
                found, rest = rest[hit], rest[~hit]
                edges += [(int(ids[i]), int(ids[j])) for j in found]
                stack += list(found)
    return edges


def spanning_prints(members: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges of the members (id, class, number of words, fingerprint) whose fingerprints differ in LIMIT bits at most."""
    rows = members.reshape(-1, HEAD + WIDTH // 64)
    prints = np.ascontiguousarray(rows[:, HEAD:]).view(np.uint64)
    if len(rows) <= 16:  # most groups are small and have no link
        apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=np.int64)
        if (apart <= LIMIT).sum() == len(rows):
            return []
    return walk(rows[:, 0], rows[:, 1], lambda i, rest: np.bitwise_count(prints[rest] ^ prints[i]).sum(axis=1, dtype=np.int64) <= LIMIT)


def stars(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """As many edges with the same components, each from a component's smallest node.

    A node then has one edge to a centre in each group, where a tree may give it any number: ``lowered`` relies on it.
    """
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [(at, x) for x in root if (at := find(x)) != x]


def _searched(groups: DataFrame, spanning: Spanning) -> DataFrame:
    """Rows with members, the concatenated words of a group -> edges (a, b)."""

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series([[{"a": a, "b": b} for a, b in stars(spanning(np.asarray(x, np.int64)))] for x in lists])

    return groups.select(F.explode(of("members")).alias("e")).select("e.a", "e.b")


def _gathered(members: DataFrame, *keys: str) -> DataFrame:
    """Lists of two members or more."""
    lists = members.groupBy(*keys).agg(F.collect_list("body").alias("members")).filter(F.size("members") > 1)
    return lists.select(F.flatten("members").alias("members"))


def member(f: Column, words: Column) -> Column:
    return F.concat(F.array(f, f, F.size(words).cast("long")), words)


def class_edges(members: DataFrame, spanning: Spanning, group: int = GROUP, words: int = WORDS) -> DataFrame:
    """Rows (k, f, body) -> edges (a, b) with the components, group by group, of all links that ``spanning`` sees.

    body is a ``member``. Groups of up to ``group`` members and ``words`` words are searched in one call.
    """
    weight = F.size("body")
    sizes = members.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    parts = F.ceil(F.greatest(F.col("n") / group, F.col("w") / words)).cast("long").alias("q")
    large = cut(sizes.filter((F.col("n") > group) | (F.col("w") > words)).select("k", "n", parts), "large")
    edges = _searched(_gathered(members.join(large, "k", "left_anti"), "k"), spanning)
    if large.isEmpty():
        return edges
    place = F.xxhash64("f", F.lit("part"))
    inside = cut(members.join(large, "k").withColumn("h", place), "inside")
    # about HUBS members of each group by their hash, in all of its parts
    hub = F.pmod(F.xxhash64("f", F.lit("hub")), F.col("n")) < HUBS
    own = F.pmod("h", F.col("q"))
    dealt = inside.select("k", "body", F.explode(F.when(hub, F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).otherwise(F.array(own))).alias("p"))
    within = cut(_searched(_gathered(dealt, "k", "p"), spanning), "within")
    found = cut(connected_components(within).select(F.col("node").alias("f"), F.col("component").alias("c")), "within-components")
    placed = cut(inside.join(found, "f", "left").select("k", "f", "h", "body", F.coalesce("c", "f").alias("c")), "placed")
    main = placed.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.max(F.struct("n", "c")).alias("m")).select("k", F.col("m.c").alias("main"))
    sided = placed.join(main, "k").withColumn("out", F.col("c") != F.col("main"))
    half = lambda out: F.ceil(F.greatest(F.sum(F.when(out, 1).otherwise(0)) * 2 / group, F.sum(F.when(out, weight).otherwise(0)) * 2 / words)).cast("long")
    counts = sided.groupBy("k").agg(half(F.col("out")).alias("qo"), half(~F.col("out")).alias("qi")).filter("qo > 0")
    part = F.when(F.col("out"), F.pmod("h", F.col("qo"))).otherwise(F.col("qo") + F.pmod("h", F.col("qi"))).alias("p")
    body = F.concat(F.slice("body", 1, 1), F.array("c"), F.slice("body", 3, weight - 2)).alias("body")
    rows = sided.join(counts, "k").select("k", body, "qo", (F.col("qo") + F.col("qi")).alias("q"), part)
    # parts 0 to qo - 1 hold the members outside; each of them meets every part, itself included
    below = F.transform(F.sequence(F.lit(0).cast("long"), F.least("p", F.col("qo") - 1)), lambda x: F.struct(x.alias("x"), F.col("p").alias("y")))
    above = F.transform(F.sequence(F.col("p"), F.col("q") - 1), lambda y: F.struct(F.col("p").alias("x"), y.alias("y")))
    cells = F.when(F.col("p") < F.col("qo"), F.array_union(below, above)).otherwise(below)
    crossed = rows.select("k", "body", F.explode(cells).alias("cell")).select("k", "cell.x", "cell.y", "body")
    return edges.unionByName(within).unionByName(_searched(_gathered(crossed, "k", "x", "y"), spanning))


def lowered(edges: DataFrame) -> DataFrame:
    """Stars' edges (centre a, member b) -> edges with the same components: a member's and its other centres' to its smallest.

    A member has a centre in each table at most (in parts of larger groups, in each part it meets), however large its groups
    are, so its centres fit a row; as members share centres, about an edge a member is left instead of one a table.
    """
    members = edges.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("centres"))
    least = F.col("centres")[0]
    return members.select(least.alias("a"), F.explode(F.concat(F.array("b"), F.slice("centres", 2, F.size("centres")))).alias("b")).distinct()


def links(prints: DataFrame, group: int = GROUP) -> DataFrame:
    """Distinct (f, keys, print) -> edges (a, b) with the components of all pairs that meet in a table and verify."""
    dealt = prints.select(F.explode("keys").alias("k"), "f", member(F.col("f"), F.col("print")).alias("body"))
    return lowered(class_edges(dealt, spanning_prints, group))
