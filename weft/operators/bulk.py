"""Graph changes and walks as calls on DataFrames, without the query language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.checkpointing import cut
from weft.errors import GraphError
from weft.functions.values import NULL, Value, as_type, loaded, null_of, unify
from weft.operators import paths
from weft.operators.mutate import unsure
from weft.sources.graph import Graph, P, properties_of


def _updated(table, changes: DataFrame, replace: bool):
    """changes (id, <property>...): given values are set, null removes; with replace, properties not named go too."""
    own = table.props
    new = {f.name: f.dataType for f in changes.schema.fields if f.name != "id"}
    side = changes.select(F.col("id").alias("_cid"), *[loaded(F.col(f"`{k}`"), t).alias(f"_c{i}") for i, (k, t) in enumerate(new.items())])
    types = properties_of(changes.select("id", *[loaded(F.col(f"`{k}`"), t).alias(P + k) for k, t in new.items()]))
    joined, cols = table.df.join(side, F.col("id") == F.col("_cid")), []
    for k in dict.fromkeys([*own, *new]):
        t = unify(own.get(k, NULL), types.get(k, NULL), f"values of the property {k}")
        if k in new:
            cols.append(as_type(Value(F.col(f"_c{list(new).index(k)}"), types[k]), t).alias(P + k))
        else:
            cols.append((null_of(t) if replace else as_type(Value(F.col(f"`{P}{k}`"), own[k]), t)).alias(P + k))
    rows = cut(joined.select(*[c for c in table.df.columns if c in ("id", "src", "dst")], *cols), "updated")
    return table if rows.isEmpty() else table.changed(rows)


def update_nodes(graph: Graph, changes: DataFrame, replace: bool = False) -> Graph:
    return graph.with_(nodes=tuple(_updated(t, changes, replace) for t in graph.nodes))


def update_edges(graph: Graph, changes: DataFrame, replace: bool = False) -> Graph:
    return graph.with_(edges=tuple(_updated(t, changes, replace) for t in graph.edges))


def _deleted(table, ids: DataFrame):
    gone = cut(ids.distinct(), "gone")
    return table if gone.isEmpty() else table.without(gone)


def delete_nodes(graph: Graph, ids: DataFrame) -> Graph:
    """Delete the nodes of ids (id) and every edge at one of them."""
    ends = lambda name: ids.select(F.col("id").alias(name)).distinct()
    at = lambda t: t.df.join(ends("src"), "src", "left_semi").select("id").unionByName(t.df.join(ends("dst"), "dst", "left_semi").select("id"))
    edges = tuple(_deleted(t, at(t)) for t in graph.edges)
    return graph.with_(nodes=tuple(_deleted(t, t.df.join(ends("id"), "id", "left_semi").select("id")) for t in graph.nodes), edges=edges)


def delete_edges(graph: Graph, ids: DataFrame) -> Graph:
    return graph.with_(edges=tuple(_deleted(t, t.df.join(ids.select("id").distinct(), "id", "left_semi").select("id")) for t in graph.edges))


def change_labels(graph: Graph, ids: DataFrame, add: list[str] = (), remove: list[str] = ()) -> Graph:
    kept, moves, keys = [], [], ids.select("id").distinct()
    for t in graph.nodes:
        labels = tuple(sorted((set(t.labels) | set(add)) - set(remove)))
        rows = cut(t.df.join(keys, "id", "left_semi").select(*t.df.columns), "moved") if labels != t.labels else None
        if rows is None or rows.isEmpty():
            kept.append(t)
        else:
            kept.append(t.without(rows.select("id")))
            moves.append((labels, rows))
    out = graph.with_(nodes=tuple(kept))
    for labels, rows in moves:
        out = out.append_nodes(labels, rows)
    return unsure(out, list(remove))


def neighbors(graph: Graph, start: int, depth: int) -> DataFrame:
    """(node, depth) of what outgoing edges reach from start in at most ``depth`` steps."""
    starts = graph.spark.createDataFrame([(start,)], "start bigint")
    return paths.neighbors(starts, graph.steps_from(None).at, depth).select("node", "depth")


def shortest_path(graph: Graph, a: int, b: int, max_hops: int | None = None) -> list[int] | None:
    """Node ids of the shortest path, the one with the least edge ids; None if there is none.

    A search that gets to ``max_hops``, if given, is an error.
    """
    edges = graph.edge_frame(keys=[])[0].select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("id").alias("e"))
    row = paths.shortest(graph.spark.createDataFrame([(a, b)], "a bigint, b bigint"), edges, False, max_hops, zero=True).first()
    return list(row["nodes"]) if row else None


def depth_first(graph: Graph, start: int, limit: int = 1_000_000) -> list[int]:
    """Preorder of the nodes reachable from start; neighbours are taken by (type, node, edge).

    A preorder is one sequence by definition, so the edges reachable from start come to the driver; more than ``limit`` of
    them are an error.
    """
    starts = graph.spark.createDataFrame([(start,)], "start bigint")
    edges = graph.edge_frame(keys=[])[0]
    near = paths.neighbors(starts, graph.steps_from(None).at, 1 << 20).select(F.col("node").alias("src")).unionByName(starts.select(F.col("start").alias("src")))
    found = edges.join(near.distinct(), "src").select("src", "type", "dst", "id").limit(limit + 1).collect()
    if len(found) > limit:
        raise GraphError("ResourceExhausted", f"more than {limit} edges are reachable")
    after: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r["type"], r["dst"], r["id"]), reverse=True):
        after.setdefault(r["src"], []).append(r["dst"])
    out, seen, stack = [], set(), [start]
    while stack:
        n = stack.pop()
        if n not in seen:
            seen.add(n)
            out.append(n)
            stack += [m for m in after.get(n, ()) if m not in seen]
    return out
