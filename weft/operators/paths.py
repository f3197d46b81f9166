"""Walks and breadth-first searches over edge tables, level by level.

A level is a join of the frontier with the edges. Few levels are one plan; more are cut by checkpoints in the shared
folder, so the plan stays small and a lost executor costs one level. Starts are searched together.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.checkpointing import cut, cut_counted
from weft.errors import GraphError

#: Levels that are planned in one piece.
UNROLLED = 4


def walks(starts: DataFrame, steps: DataFrame, least: int, most: int | None, max_hops: int) -> DataFrame:
    """starts (start), steps (u, v, e) -> (start, node, edges, nodes): walks that use no edge twice.

    nodes are those after the start. An open or overlong upper bound ends at max_hops: a walk that gets there is an error.
    """
    open_end = most is None or most > max_hops
    last = max_hops if open_end else most
    none = F.array().cast("array<bigint>")
    frontier = starts.select("start", F.col("start").alias("node"), none.alias("edges"), none.alias("nodes"))
    if last > UNROLLED:
        steps = cut(steps.select("u", "v", "e"), "steps")
    out = None
    for level in range(1, last + 1):
        grown = frontier.join(steps, F.col("node") == F.col("u")).filter(~F.array_contains("edges", F.col("e")))
        frontier = grown.select("start", F.col("v").alias("node"), F.array_append("edges", F.col("e")).alias("edges"), F.array_append("nodes", F.col("v")).alias("nodes"))
        if open_end or last > UNROLLED:
            frontier, counts = cut_counted(frontier, "walk", n=F.count(F.lit(1)))
            if not counts["n"]:
                break
            if open_end and level == last:
                raise GraphError("ResourceExhausted", f"a path reached the limit of {max_hops} hops")
        if level >= least:
            out = frontier if out is None else out.unionByName(frontier)
    return out if out is not None else frontier.limit(0)


def neighbors(starts: DataFrame, steps_at, depth: int) -> DataFrame:
    """(start, node, depth) of what steps reach in at most so many levels, the start left out.

    steps_at(level) are the edges (src, dst) that a level can take.
    """
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    frontier, kept = seen, {}
    for level in range(1, depth + 1):
        edges = steps_at(level)
        if edges is None:
            break
        if depth > UNROLLED and id(edges) not in kept:
            kept[id(edges)] = (edges, cut(edges.select("src", "dst"), "steps"))
        steps = (kept[id(edges)][1] if id(edges) in kept else edges).select(F.col("src").alias("u"), F.col("dst").alias("v"))
        found = frontier.join(steps, F.col("node") == F.col("u")).select("start", F.col("v").alias("node")).distinct()
        frontier = found.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(level))
        if depth > UNROLLED:
            frontier, counts = cut_counted(frontier, "near", n=F.count(F.lit(1)))
            if not counts["n"]:
                break
        seen = seen.unionByName(frontier)
        if depth > UNROLLED and level % 8 == 0:
            seen = cut(seen, "seen")
    return seen.filter("depth > 0")


def shortest(pairs: DataFrame, steps: DataFrame, every: bool, max_hops: int | None, least: int = 1, most: int | None = None, zero: bool = False) -> DataFrame:
    """pairs (a, b), steps (u, v, e) -> (a, b, nodes, edges): shortest paths, the least edge sequence or all of them.

    zero: a node is at distance 0 from itself; else a pair of one node has no path. A distance below ``least`` is no path.
    The least sequence to a node continues the least sequence to the node before it on its level, so one minimum for each
    start and node is kept; with ``every``, all edge sequences of a level are kept. Without ``max_hops`` the search ends
    when nothing new is reached; an open or overlong upper bound ends at max_hops, and a search that gets there is an error.

    A level is one job: it drops starts without targets left, steps on, drops what was seen, marks targets, and is written
    down while its rows and targets are counted.
    """
    pairs, total = cut_counted(pairs, "pairs", n=F.count(F.when(F.col("a") != F.col("b"), 1)))
    wanted = total["n"]
    open_end = max_hops is not None and (most is None or most > max_hops)
    last = max_hops if open_end else most
    if wanted and (last is None or last > 2):
        steps = cut(steps.select("u", "v", "e"), "steps")  # read at each level: filters and unions are worked out once
    none = F.array().cast("array<bigint>")
    same = pairs.filter("a = b").select("a", "b", F.array("a").alias("nodes"), none.alias("edges"))
    out = same if zero else same.limit(0)
    targets = pairs.filter("a <> b").select(F.col("a").alias("start"), F.col("b").alias("node"))
    if not wanted:
        return out
    frontier = targets.select("start").distinct().select("start", F.col("start").alias("node"), none.alias("edges"), F.array("start").alias("nodes"))
    seen, hits = frontier.select("start", "node"), 0
    for level in count(1) if last is None else range(1, last + 1):
        if hits:  # targets were reached a level ago: starts that have no others stop here
            frontier = frontier.join(targets.join(seen, ["start", "node"], "left_anti").select("start").distinct(), "start", "left_semi")
        grown = frontier.join(steps, F.col("node") == F.col("u")).select("start", F.col("v").alias("node"), F.array_append("edges", F.col("e")).alias("edges"), F.array_append("nodes", F.col("v")).alias("nodes"))
        if open_end and level == last and not grown.isEmpty():
            raise GraphError("ResourceExhausted", f"a path reached the limit of {max_hops} hops")
        grown = grown.join(seen, ["start", "node"], "left_anti")
        if not every:
            grown = grown.groupBy("start", "node").agg(F.min(F.struct("edges", "nodes")).alias("m")).select("start", "node", "m.edges", "m.nodes")
        marked = grown.join(targets.withColumn("hit", F.lit(True)), ["start", "node"], "left")
        frontier, found = cut_counted(marked, "front", n=F.count(F.lit(1)), hits=F.count("hit"))
        if not found["n"]:
            break
        hits = found["hits"]
        if every and hits:  # several sequences lead to one target
            hits = frontier.filter("hit").select("start", "node").distinct().count()
        wanted -= hits
        if level >= least and hits:
            out = out.unionByName(frontier.filter("hit").select(F.col("start").alias("a"), F.col("node").alias("b"), "nodes", "edges"))
        if not wanted:
            break
        frontier = frontier.drop("hit")
        seen = seen.unionByName(frontier.select("start", "node").distinct() if every else frontier.select("start", "node"))
        if level % 8 == 0:  # what was seen is the union of levels, written anew now and then to keep the plan short
            seen = cut(seen, "seen")
    return out
