"""The property graph: one DataFrame for each set of node labels and for each kind of edge, plus a catalog.

Property columns are called ``p_<key>``; node tables have ``id``, edge tables ``id, src, dst``. A graph is an immutable
version: a mutation gives a new one that shares all untouched tables. A table is a list of parts, rows that were added and
ids that are gone from the parts before, so a version differs from the one before by the parts that its mutation made.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from weft.checkpointing import cut
from weft.errors import GraphError
from weft.functions.values import NULL, Type, Value, as_type, from_spark, loaded, null_of, unify

P = "p_"
#: A loaded timestamp also keeps its native column under this prefix, for filters that a scan can take.
NATIVE = "t_"


#: Parts of a table after which those behind the first are folded into two.
PARTS = 16


@dataclass(frozen=True)
class Part:
    """Rows of a table, or with ``gone`` the ids (id) that are no more in the parts before. On storage it has a path."""

    df: DataFrame
    gone: bool = False
    path: str | None = None


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both tables, with all properties of either."""
    if a.columns == b.columns and a.schema == b.schema:
        return a.unionByName(b)
    pa, pb = properties_of(a), properties_of(b)
    kinds = {k: unify(pa.get(k, NULL), pb.get(k, NULL), f"values of the property {k}") for k in {**pa, **pb}}
    lead = [c for c in a.columns if c in ("id", "src", "dst")]
    side = lambda df, own: df.select(*lead, *[(as_type(Value(F.col(f"`{P}{k}`"), own[k]), t) if k in own else null_of(t)).alias(P + k) for k, t in kinds.items()])
    return side(a, pa).unionByName(side(b, pb))


def properties_of(df: DataFrame) -> dict[str, Type]:
    return {f.name[len(P) :]: from_spark(f.dataType) for f in df.schema.fields if f.name.startswith(P)}


def read_parts(parts: tuple[Part, ...]) -> DataFrame:
    out = None
    for x in parts:
        out = x.df if out is None else out.join(x.df.select("id"), "id", "left_anti").select(*out.columns) if x.gone else merged(out, x.df)
    return out


@dataclass(frozen=True)
class _Table:
    """What node and edge tables share."""

    @property
    def props(self) -> dict[str, Type]:
        return properties_of(self.df)

    @property
    def deltas(self) -> tuple[Part, ...]:
        return self.parts or (Part(self.df),)

    def _with(self, *new: Part):
        parts = (*self.deltas, *new)
        if len(parts) <= PARTS:
            df = self.df
            for x in new:
                df = df.join(x.df.select("id"), "id", "left_anti").select(*df.columns) if x.gone else merged(df, x.df)
            return replace(self, df=df, parts=parts)
        return replace(self, **_folded(parts))

    def added(self, df: DataFrame):
        return self._with(Part(df))

    def without(self, ids: DataFrame):
        """ids (id), of rows that the table has."""
        return self._with(Part(ids, True))

    def changed(self, rows: DataFrame):
        """rows take the place of those with their ids."""
        return self._with(Part(rows.select("id"), True), Part(rows))

    def compact(self):
        return self if len(self.deltas) == 1 else replace(self, parts=None)


def _folded(parts: tuple[Part, ...]) -> dict:
    """The first part, all ids that are gone from it, and all rows of later parts that are left: two parts are written."""
    first, rest = parts[0], parts[1:]
    gone = [x.df.select("id") for x in rest if x.gone]
    rows, have = None, []
    for x in rest:
        if not x.gone:
            rows = x.df if rows is None else merged(rows, x.df)
        elif rows is not None:
            rows = rows.join(x.df.select("id"), "id", "left_anti").select(*rows.columns)
    if gone:
        have.append(Part(cut(reduce(DataFrame.unionByName, gone).distinct(), "gone"), True))
    if rows is not None:
        have.append(Part(cut(rows, "rows")))
    out = (first, *have)
    return {"df": read_parts(out), "parts": out}


@dataclass(frozen=True)
class NodeTable(_Table):
    labels: tuple[str, ...]
    df: DataFrame
    parts: tuple[Part, ...] | None = field(default=None, compare=False)

    def satisfies(self, groups: list[list[str]]) -> bool:
        return all(any(name in self.labels for name in g) for g in groups)


@dataclass(frozen=True)
class EdgeTable(_Table):
    type: str
    df: DataFrame
    src_labels: tuple[tuple[str, ...], ...] | None = None  # label sets of the node tables that ends come from, if known
    dst_labels: tuple[tuple[str, ...], ...] | None = None
    parts: tuple[Part, ...] | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Index:
    name: str
    entity: str
    label: str
    props: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class Constraint:
    name: str
    kind: str
    entity: str
    label: str
    prop: str
    type: str | None = None


@dataclass(frozen=True)
class Graph:
    spark: SparkSession
    nodes: tuple[NodeTable, ...] = ()
    edges: tuple[EdgeTable, ...] = ()
    indexes: tuple[Index, ...] = ()
    constraints: tuple[Constraint, ...] = ()
    next_node: int = 1
    next_edge: int = 1
    version: int = 0
    loaded: tuple[tuple[str, DataFrame], ...] = field(default=(), compare=False)  # of which the largest ids aren't known yet
    streams: tuple[tuple[str, int], ...] = ()  # last batch of each stream
    stats: dict = field(default_factory=dict, compare=False)

    def with_(self, **changes) -> Graph:
        return replace(self, **changes)

    # ------------------------------------------------------------------------------------------------------- reading
    def node_tables(self, groups: list[list[str]] = ()) -> list[NodeTable]:
        return [t for t in self.nodes if t.satisfies(groups)]

    def edge_tables(self, types: list[str] = ()) -> list[EdgeTable]:
        return [t for t in self.edges if not types or t.type in types]

    def properties(self, tables) -> dict[str, Type]:
        out: dict[str, Type] = {}
        for t in tables:
            for k, kind in t.props.items():
                out[k] = unify(out.get(k, NULL), kind, f"values of the property {k}")
        return out

    def node_frame(self, groups: list[list[str]] = (), keys: list[str] | None = None) -> tuple[DataFrame, dict[str, Type]]:
        """(id, labels, p_<key>...) of the nodes with these labels; all properties if keys is None."""
        tables = self.node_tables(groups)
        return self._frame(tables, keys, lambda t: [F.col("id"), F.array(*[F.lit(x) for x in t.labels]).cast("array<string>").alias("labels")], "id bigint, labels array<string>")

    def edge_frame(self, types: list[str] = (), keys: list[str] | None = None) -> tuple[DataFrame, dict[str, Type]]:
        """(id, src, dst, type, p_<key>...) of the edges of these types."""
        tables = self.edge_tables(types)
        return self._frame(tables, keys, lambda t: [F.col("id"), F.col("src"), F.col("dst"), F.lit(t.type).alias("type")], "id bigint, src bigint, dst bigint, type string")

    def steps_from(self, sets: list[tuple[str, ...]] | None) -> Steps:
        return Steps(self, sets)

    def _frame(self, tables, keys, lead, empty: str) -> tuple[DataFrame, dict[str, Type]]:
        have = self.properties(tables)
        if keys is not None:
            have = {k: have[k] for k in keys if k in have}
        # native columns go along where every table that has the property has one
        native = [k for k, kind in have.items() if kind.kind == "datetime" and all(k not in t.props or NATIVE + k in t.df.columns for t in tables)]
        out = None
        for t in tables:
            own = t.props
            cols = [as_type(Value(F.col(f"`{P}{k}`"), own[k]), kind) if k in own else null_of(kind) for k, kind in have.items()]
            part = t.df.select(*lead(t), *[c.alias(P + k) for c, k in zip(cols, have, strict=True)], *[F.col(f"`{NATIVE}{k}`") if k in own else F.lit(None).cast("timestamp").alias(NATIVE + k) for k in native])
            out = part if out is None else out.unionByName(part)
        return (out if out is not None else self.spark.createDataFrame([], empty)), have

    # -------------------------------------------------------------------------------------------------- whole graph
    def labels(self) -> list[str]:
        return sorted({x for t in self.nodes for x in t.labels if not t.df.isEmpty()})

    def edge_types(self) -> list[str]:
        return sorted({t.type for t in self.edges if not t.df.isEmpty()})

    def property_keys(self) -> list[str]:
        """Keys that some node or edge has; a table's keys are tested in one pass."""
        found = set()
        for t in (*self.nodes, *self.edges):
            keys = [k for k in t.props if k not in found]
            if keys:
                row = t.df.agg(*[F.max(F.col(f"`{P}{k}`").isNotNull()).alias(f"k{i}") for i, k in enumerate(keys)]).first()
                found |= {k for i, k in enumerate(keys) if row[f"k{i}"]}
        return sorted(found)

    def counts(self) -> dict:
        nodes = {t: t.df.count() for t in self.nodes}
        edges = {t: t.df.count() for t in self.edges}
        by_label, by_type = {}, {}
        for t, n in nodes.items():
            for x in t.labels:
                by_label[x] = by_label.get(x, 0) + n
        for t, n in edges.items():
            by_type[t.type] = by_type.get(t.type, 0) + n
        return {"nodes": sum(nodes.values()), "edges": sum(edges.values()), "labels": by_label, "types": by_type}

    # ------------------------------------------------------------------------------------------------- bulk interface
    def add_nodes(self, df: DataFrame, labels: list[str], id_col: str = "id", below: int | None = None) -> Graph:
        """Add a DataFrame of nodes whose ids are given; other columns become properties.

        New ids are given out above all others. If ``below`` tells a bound of the given ids, they needn't be read for it.
        """
        rows = _as_table(df, {id_col: "id"})
        return self._noted("node", rows, below).append_nodes(tuple(sorted(set(labels))), rows)

    def add_edges(self, df: DataFrame, type: str, id_col: str = "id", src_col: str = "src", dst_col: str = "dst", src_labels: list[list[str]] | None = None, dst_labels: list[list[str]] | None = None, below: int | None = None, check: bool = True) -> Graph:
        """Add a DataFrame of edges, whose ends must be there unless ``check`` is off (for sources with foreign keys).

        Naming the label sets of the ends lets patterns leave out joins with nodes.
        """
        rows = _as_table(df, {id_col: "id", src_col: "src", dst_col: "dst"})
        if check:
            self.check_ends(rows, type)
        ends = lambda x: tuple(tuple(sorted(s)) for s in x) if x is not None else None
        return self._noted("edge", rows, below).append_edges(type, rows, ends(src_labels), ends(dst_labels))

    def check_ends(self, edges: DataFrame, type: str) -> None:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        nodes = [t.df.select("id") for t in self.nodes]
        lost = ends.join(reduce(DataFrame.unionByName, nodes), "id", "left_anti") if nodes else ends
        if not lost.isEmpty():
            raise GraphError("NotFound", f"an end of the {type} relationship doesn't exist")

    def _noted(self, kind: str, rows: DataFrame, below: int | None) -> Graph:
        if below is None:
            return self.with_(loaded=(*self.loaded, (kind, rows)))
        name = f"next_{kind}"
        return self.with_(**{name: max(getattr(self, name), below)})

    def settled(self) -> Graph:
        """The graph with ids to give out that are above all that were loaded: one pass over the ids not read yet."""
        if not self.loaded:
            return self
        each = [df.select(F.lit(kind).alias("kind"), "id") for kind, df in self.loaded]
        found = {r["kind"]: r["m"] for r in reduce(DataFrame.unionByName, each).groupBy("kind").agg(F.max("id").alias("m")).collect()}
        above = lambda kind, now: max(now, (found.get(kind) or 0) + 1)
        return self.with_(next_node=above("node", self.next_node), next_edge=above("edge", self.next_edge), loaded=())

    def append_nodes(self, labels: tuple[str, ...], rows: DataFrame) -> Graph:
        for i, t in enumerate(self.nodes):
            if t.labels == labels:
                return self.with_(nodes=(*self.nodes[:i], t.added(rows), *self.nodes[i + 1 :]))
        return self.with_(nodes=(*self.nodes, NodeTable(labels, rows)))

    def append_edges(self, kind: str, rows: DataFrame, src_labels=None, dst_labels=None) -> Graph:
        """Rows go to the table of their type whose ends are known as theirs are."""
        for i, t in enumerate(self.edges):
            if (t.type, t.src_labels, t.dst_labels) == (kind, src_labels, dst_labels):
                return self.with_(edges=(*self.edges[:i], t.added(rows), *self.edges[i + 1 :]))
        return self.with_(edges=(*self.edges, EdgeTable(kind, rows, src_labels, dst_labels)))

    def export(self, path: str) -> None:
        """Write the whole graph below path, where no graph may be: one file set a table, and the catalog."""
        from weft.sources import store

        if store.load(self.spark, path).version:
            raise GraphError("AlreadyExists", f"there is a graph at {path}")
        store.save(self.with_(nodes=tuple(t.compact() for t in self.nodes), edges=tuple(t.compact() for t in self.edges)), path)

    def nodes_of(self, label: str | None = None) -> DataFrame:
        return self.node_frame([[label]] if label else [])[0]

    def edges_of(self, type: str | None = None) -> DataFrame:
        return self.edge_frame([type] if type else [])[0]

    def get_node(self, node: int) -> DataFrame:
        return self.nodes_of().filter(F.col("id") == node)

    def get_edge(self, edge: int) -> DataFrame:
        return self.edges_of().filter(F.col("id") == edge)

    def edges_between(self, a: int, b: int) -> DataFrame:
        return self.edges_of().filter((F.col("src") == a) & (F.col("dst") == b))

    def incident_edges(self, node: int) -> DataFrame:
        return self.edges_of().filter((F.col("src") == node) | (F.col("dst") == node))

    # ------------------------------------------------------------------------------------- lookups by a property value
    def nodes_by(self, label: str | None, key: str, op: str, value, upper=None) -> DataFrame:
        """Nodes whose property compares to a constant: op is =, <, <=, >, >=, STARTS WITH, or RANGE (from value to below
        upper). The comparison is a filter on the property's column, so it reaches the scan."""
        return self._by(*self.node_frame([[label]] if label else []), key, op, value, upper)

    def edges_by(self, type: str | None, key: str, op: str, value, upper=None) -> DataFrame:
        return self._by(*self.edge_frame([type] if type else []), key, op, value, upper)

    def _by(self, frame: DataFrame, types: dict[str, Type], key: str, op: str, value, upper) -> DataFrame:
        if key not in types:
            return frame.limit(0)
        col = F.col(f"`{P}{key}`")
        conditions = {"=": lambda: col == value, "<": lambda: col < value, "<=": lambda: col <= value, ">": lambda: col > value, ">=": lambda: col >= value, "STARTS WITH": lambda: col.startswith(value), "RANGE": lambda: (col >= value) & (col < upper)}
        if op not in conditions:
            raise GraphError("InvalidArgument", f"there is no comparison {op}")
        return frame.filter(conditions[op]())


class Steps:
    """Edges that walks along their direction can take, level by level, told from the label sets of the starts.

    An edge table that knows label sets of its sources is left out of a level that no node table with these reaches.
    """

    def __init__(self, graph: Graph, sets: list[tuple[str, ...]] | None):
        self.graph, self.reached = graph, [{t.labels for t in graph.nodes} if sets is None else set(sets)]
        self.made: dict[tuple[int, ...], DataFrame] = {}

    def _tables(self, level: int) -> list[EdgeTable]:
        has = lambda labels, wanted: wanted is None or any(set(w) <= set(labels) for w in wanted)
        of = lambda now: [t for t in self.graph.edges if any(has(x, t.src_labels) for x in now)]
        while len(self.reached) < level:
            tables = of(self.reached[-1])
            self.reached.append({t.labels for t in self.graph.nodes if any(has(t.labels, e.dst_labels) for e in tables)})
        return of(self.reached[level - 1])

    def _frame(self, tables: list[EdgeTable]) -> DataFrame | None:
        key = tuple(id(t) for t in tables)
        if tables and key not in self.made:
            self.made[key] = reduce(DataFrame.unionByName, [t.df.select("id", "src", "dst") for t in tables])
        return self.made.get(key)

    def at(self, level: int) -> DataFrame | None:
        """(id, src, dst) of the edges of a level, from 1; None if there are none."""
        return self._frame(self._tables(level))

    def all(self) -> DataFrame:
        """Those of all levels."""
        level, found = 1, []
        while True:
            new = [t for t in self._tables(level) if not any(t is x for x in found)]
            if level > 1 and not new and self.reached[level - 1] <= set().union(*self.reached[: level - 1]):
                break
            found += new
            level += 1
        return self._frame(found) if found else self.graph.spark.createDataFrame([], "id bigint, src bigint, dst bigint")


def _as_table(df: DataFrame, names: dict[str, str]) -> DataFrame:
    cols: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in names:
            cols.append(c.cast("bigint").alias(names[f.name]))
        else:
            cols.append(loaded(c, f.dataType).alias(P + f.name))
            if isinstance(f.dataType, TimestampType):
                cols.append(c.alias(NATIVE + f.name))
    return df.select(*cols)


def empty(spark: SparkSession) -> Graph:
    return Graph(spark)
