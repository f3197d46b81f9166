"""The binding table: a DataFrame with one generated column for each thing that a name in scope needs."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.errors import GraphError
from weft.functions.values import INT, NULL, PATH, STRING, Type, Value, bad, ddl, fail, list_of, map_of
from weft.operators import paths
from weft.sources.graph import P, Graph

_numbers = count()


def fresh(what: str = "c") -> str:
    return f"_{what}{next(_numbers)}"


@dataclass
class Context:
    spark: SparkSession
    graph: Graph
    params: dict = field(default_factory=dict)
    max_hops: int = 128
    now: str | None = None
    needed: set[str] = field(default_factory=set)  # variables of which more than the id is read
    ways: set[str] = field(default_factory=set)  # directions of the degrees that the query asks for
    seed: int | None = None  # of rand()
    rows_by_clause: list | None = None  # for PROFILE: (clause, observation of its rows)


class Rows:
    def __init__(self, context: Context, df: DataFrame, names: dict[str, Value] | None = None, unit: bool = False):
        self.context, self.df, self.vars, self.unit = context, df, dict(names or {}), unit
        self.order: str | None = None  # a column that tells the order that ORDER BY gave
        self.bare = False  # whether these are all nodes of some labels, once each

    @classmethod
    def one(cls, context: Context) -> Rows:
        return cls(context, context.spark.range(1).select(F.lit(1).alias(fresh("unit"))), unit=True)

    def copy(self, df: DataFrame | None = None, names: dict[str, Value] | None = None) -> Rows:
        out = Rows(self.context, self.df if df is None else df, self.vars if names is None else names)
        out.order = self.order
        return out

    # ------------------------------------------------------------------------------------------------------- columns
    def named(self, col: Column, what: str = "t") -> str:
        """Give an expression a column of its own."""
        name = fresh(what)
        self.df = self.df.withColumn(name, col)
        return name

    def _joined(self, on: Column, right: DataFrame, key: str) -> None:
        """Left join by one column of a table that has its values at most once."""
        name = self.named(on, "k")
        self.df = self.df.join(right.withColumnRenamed(key, name), name, "left")

    def entities(self, kind: str) -> DataFrame:
        return self.context.graph.node_frame()[0] if kind == "node" else self.context.graph.edge_frame()[0]

    def lookup(self, v: Value, key: str) -> Value:
        """A property of a node or edge that no pattern carries: by its id."""
        graph = self.context.graph
        frame, types = graph.node_frame(keys=[key]) if v.kind == "node" else graph.edge_frame(keys=[key])
        if key not in types:
            return Value(F.lit(None), NULL)
        name = fresh("p")
        self._joined(v.col, frame.select("id", F.col(f"`{P}{key}`").alias(name)), "id")
        return Value(F.col(name), types[key])

    def element_property(self, element: Value, lists: Column, key: str) -> Value:
        """A property of an element of a list of ids, inside a lambda: looked up in a map that a join brings."""
        cache = self.__dict__.setdefault("_maps", {})
        at = (str(lists), element.kind, key)
        if at not in cache:
            graph = self.context.graph
            frame, types = graph.node_frame(keys=[key]) if element.kind == "node" else graph.edge_frame(keys=[key])
            if key not in types:
                cache[at] = (None, NULL)
            else:
                on, out = self.named(lists, "l"), fresh("m")
                ids = self.df.select(on).distinct().select(on, F.explode(F.array_distinct(on)).alias("id"))
                found = ids.join(frame.select("id", F.col(f"`{P}{key}`").alias("v")), "id")
                maps = found.groupBy(on).agg(F.map_from_entries(F.collect_list(F.struct("id", "v"))).alias(out))
                self.df = self.df.join(maps, on, "left")
                cache[at] = (out, types[key])
        out, t = cache[at]
        return Value(F.lit(None), NULL) if out is None else Value(F.try_element_at(F.col(out), element.col), t)

    def entity_field(self, v: Value, name: str) -> Column:
        out = fresh(name)
        self._joined(v.col, self.entities(v.kind).select("id", F.col(name).alias(out)), "id")
        return F.col(out)

    def entity_properties(self, v: Value) -> Value:
        have = self._whole(v)
        t = map_of({k: x for k, (_, x) in have.items()})
        cols = [F.col(have[k][0]).alias(k) for k, _ in t.fields]
        return Value(F.when(v.col.isNotNull(), F.struct(*cols)) if cols else F.struct(), t)

    def entity_keys(self, v: Value) -> Value:
        have = self._whole(v)
        named = [F.when(F.col(c).isNotNull(), F.lit(k)) for k, (c, _) in sorted(have.items())]
        return Value(F.when(v.col.isNotNull(), F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")), list_of(STRING))

    def _whole(self, v: Value) -> dict[str, tuple[str, Type]]:
        if v.extra.get("whole"):
            return v.props
        frame, types = self.context.graph.node_frame() if v.kind == "node" else self.context.graph.edge_frame()
        names = {k: fresh("p") for k in types}
        self._joined(v.col, frame.select("id", *[F.col(f"`{P}{k}`").alias(c) for k, c in names.items()]), "id")
        return {k: (names[k], types[k]) for k in types}

    # ----------------------------------------------------------------------------------------------------- traversals
    def traversal(self, low: str, args: list[Value]) -> Value:
        steps = self.context.graph.steps_from(args[0].extra.get("sets"))
        if low == "degree":
            way = args[1].const if len(args) > 1 else "out"
            if way not in ("out", "in", "both"):
                bad("the direction is out, in or both")
            return Value(F.when(args[0].col.isNotNull(), F.coalesce(F.col(self._degree(args[0].col, way)), F.lit(0).cast("bigint"))), INT)
        if low == "neighbors":
            if not args[1].known or args[1].kind != "int" or args[1].const < 0:
                bad("the depth is an integer constant of at least 0")
            on, out = self.named(args[0].col, "n"), fresh("nb")
            starts = self.df.select(F.col(on).alias("start")).filter("start is not null").distinct()
            found = paths.neighbors(starts, steps.at, args[1].const)
            lists = found.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("x")).select(F.col("start").alias(on), F.transform("x", lambda s: s["node"]).alias(out))
            self.df = self.df.join(lists, on, "left")
            return Value(F.when(F.col(on).isNotNull(), F.coalesce(F.col(out), F.array().cast("array<bigint>"))), list_of(Type("node")))
        a, b = self.named(args[0].col, "a"), self.named(args[1].col, "b")
        pairs = self.df.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null").distinct()
        every = low == "allshortestpaths"
        edges = steps.all().select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("id").alias("e"))
        found = paths.shortest(pairs, edges, every, None, zero=True)
        out = fresh("sp")
        path = F.struct("nodes", "edges")
        if every:
            found = found.groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("edges", path.alias("p")))), lambda s: s["p"]).alias(out))
        else:
            found = found.select("a", "b", path.alias(out))
        found = found.withColumnsRenamed({"a": a, "b": b})
        self.df = self.df.join(found, [a, b], "left")
        missing = F.col(a).isNull() | F.col(b).isNull()
        if every:
            t = list_of(PATH)
            return Value(F.when(~missing, F.coalesce(F.col(out), F.array().cast(ddl(t)))), t)
        return Value(F.col(out), PATH)

    def _degree(self, node: Column, way: str) -> str:
        """The column with a node's degree; all directions that the query asks for come from one pass over the edges."""
        cache, at = self.__dict__.setdefault("_degrees", {}), str(node)
        if way not in cache.get(at, {}):
            ways = sorted((self.context.ways | {way}) - set(cache.get(at, {})))
            edges = self.context.graph.edge_frame(keys=[])[0]
            end = lambda col, out, into, both: F.struct(F.col(col).alias("n"), F.lit(out).alias("out"), F.lit(into).alias("in"), both.alias("both"))
            ends = [end("src", 1, 0, F.lit(1))] if ways == ["out"] else [end("dst", 0, 1, F.lit(1))] if ways == ["in"] else [end("src", 1, 0, F.lit(1)), end("dst", 0, 1, F.when(F.col("src") != F.col("dst"), 1).otherwise(0))]
            each = edges.select(F.explode(F.array(*ends)).alias("x")).select("x.*") if len(ends) > 1 else edges.select(ends[0].alias("x")).select("x.*")
            names, on = {w: fresh("d") for w in ways}, self.named(node, "n")
            asked = self.df.select(F.col(on).alias("n")).distinct()
            counted = each.join(asked, "n", "left_semi").groupBy("n").agg(*[F.sum(w).alias(names[w]) for w in ways])
            self._joined(F.col(on), counted, "n")
            cache[at] = cache.get(at, {}) | names
        return cache[at][way]

    def check(self, name: str) -> Value:
        if name not in self.vars:
            raise GraphError("Semantic", f"{name} is not defined")
        return self.vars[name]


__all__ = ["Context", "Rows", "fail", "fresh"]
