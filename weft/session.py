"""Sessions: scripts, transactions, schema commands, databases, results."""

from __future__ import annotations

import datetime as dt
import json
import re
import threading
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from weft.checkpointing import cut
from weft.errors import GraphError, translated
from weft.functions.values import KEYS, NULL, STRING, Type, Value, as_type, null_of, unify
from weft.lang import ast as A
from weft.lang import check as C
from weft.lang import legacy
from weft.lang.parser import parse
from weft.operators.match import match
from weft.operators.mutate import Summary, Writer
from weft.operators.project import project, union, unwind
from weft.plans import explain
from weft.plans.expressions import Compiler, walk
from weft.plans.rows import Context, Rows, fresh
from weft.sources import store
from weft.sources.graph import Constraint, Graph, Index, P, properties_of

DATABASE_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_-]{0,62}\Z")
KEPT_DATABASES = ("system", "default")
_HISTOGRAM_BUCKETS = 64


@dataclass
class Result:
    columns: list[str]
    df: DataFrame | None
    types: list[str] = field(default_factory=list)
    summary: dict[str, int] = field(default_factory=dict)
    notifications: list[str] = field(default_factory=list)
    profile: list[str] = field(default_factory=list)
    timeout: float | None = None

    def rows(self) -> list[tuple]:
        """All rows on the driver; for results that are known to be small."""
        if self.df is None:
            return []
        with deadline(self.df.sparkSession, self.timeout):
            return [tuple(_plain(x) for x in r) for r in self.df.collect()]

    def batches(self, size: int = 256):
        """Rows in lists of at most ``size``, one partition at a time on the driver."""
        batch = []
        for r in self.df.toLocalIterator() if self.df is not None else ():
            batch.append(tuple(_plain(x) for x in r))
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield batch


@contextmanager
def deadline(spark: SparkSession, seconds: float | None):
    """Spark's errors as graph errors; jobs that are still running after so many seconds are cancelled, which is one."""
    context, late = spark.sparkContext, threading.Event()
    if seconds is not None:
        group = uuid.uuid4().hex

        def stop() -> None:
            late.set()
            context.cancelJobGroup(group)

        context.setJobGroup(group, "a statement with a time limit", True)
        timer = threading.Timer(seconds, stop)
        timer.start()
    try:
        yield
    except Exception as e:
        error = GraphError("DeadlineExceeded", f"the statement took over {seconds} seconds") if late.is_set() else translated(e)
        raise error from (None if error is e else e)
    finally:
        if seconds is not None:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)


def _plain(x):
    if isinstance(x, S.Row):
        if x.__fields__ == ["nodes", "edges"] and x.nodes == []:
            return []  # all shortest paths of nodes without one
        if x.__fields__ == ["rank", "num", "text", "kind"]:
            return {"string": lambda: x.text, "int": lambda: int(x.num), "float": lambda: x.num, "bool": lambda: x.num == 1, "date": lambda: dt.date(1970, 1, 1) + dt.timedelta(int(x.num)), "list": lambda: json.loads(x.text), "map": lambda: json.loads(x.text)}[x.kind]()
        have = x.asDict()
        own = have.pop(KEYS, None)
        return {k: _plain(v) for k, v in have.items() if own is None or k in own}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    return bytes(x) if isinstance(x, bytearray) else x


def needed_names(statement: A.Query) -> set[str]:
    """Variables of which a query reads more than the id: anything but patterns, id(v), count(v) and plain v."""
    out: set[str] = set()

    def look(x: A.Node) -> None:
        if isinstance(x, (A.Prop, A.Index)) and isinstance(x.base, A.Var):
            out.add(x.base.name)
        if isinstance(x, A.Call) and x.name.lower() in ("labels", "properties", "keys"):
            out.update(a.name for a in x.args if isinstance(a, A.Var))

    for part in statement.parts:
        for c in part:
            for x in walk(c):
                look(x)
            if isinstance(c, (A.SetClause, A.Remove)):
                out.update(i.name for i in c.items)
    return out


def degree_ways(statement: A.Query) -> set[str]:
    """The directions of all degrees that a query asks for."""
    calls = [x for part in statement.parts for c in part for x in walk(c) if isinstance(x, A.Call) and x.name.lower() == "degree"]
    asked = {c.args[1].value if len(c.args) > 1 and isinstance(c.args[1], A.Lit) else "out" for c in calls}
    return asked & {"out", "in", "both"}


class Session:
    """Runs scripts against a graph, held in memory or, with a root folder, in versions on storage."""

    def __init__(self, spark: SparkSession, graph: Graph | None = None, root: str | None = None, max_hops: int = 128, now: str | None = None, seed: int | None = None, timeout: float | None = None, max_writes: int | None = None):
        """seed: of rand(). timeout: seconds for the jobs of a statement, and again for reading its rows. max_writes: nodes
        and relationships created or deleted, properties and labels changed by one statement, or that is an error."""
        self.spark, self.root, self.database = spark, root.rstrip("/") if root else None, "default"
        self.max_hops, self.now, self.seed, self.timeout, self.max_writes = max_hops, now, seed, timeout, max_writes
        self._graph = graph or (store.load(spark, self._place()) if root else Graph(spark))
        self._open: Graph | None = None  # the version that an explicit transaction has so far
        self._base: Graph | None = None
        self._read_only = False
        self._transactions = 0

    def _place(self, name: str | None = None) -> str:
        return f"{self.root}/{name or self.database}"

    @property
    def graph(self) -> Graph:
        return self._open if self._open is not None else self._graph

    # ----------------------------------------------------------------------------------------------------------- runs
    def run(self, source: str, params: dict | None = None) -> list[Result]:
        """One result for each statement. An error ends the script; what was committed before stays."""
        source, notes = legacy.translate(source)
        statements = parse(source)
        for s in statements:
            C.check(s)
        out = []
        for s in statements:
            with deadline(self.spark, self.timeout):
                result = self._statement(s, params or {})
            result.notifications, result.timeout = notes, self.timeout
            out.append(result)
        return out

    def query(self, source: str, params: dict | None = None) -> DataFrame:
        """The rows of a script's last statement."""
        return self.run(source, params)[-1].df

    def _statement(self, s: A.Node, params: dict) -> Result:
        if isinstance(s, A.Explain):
            return self._explain(s, params)
        if isinstance(s, A.Begin):
            if self._open is not None:
                raise GraphError("InvalidArgument", "a transaction is open already")
            self._open, self._base, self._read_only = self._graph, self._graph, s.read_only
            self._transactions += 1
            return Result([], None)
        if isinstance(s, A.Command):
            return self._command(s, params)
        if self._read_only and C.writes(s):
            raise GraphError("InvalidArgument", "the transaction only reads")
        return self._query(s, params)

    def _query(self, s: A.Query, params: dict, observed: list | None = None) -> Result:
        context = Context(self.spark, self.graph, params, self.max_hops, self.now, needed_names(s), degree_ways(s), self.seed, observed)
        summary, out = Summary(), None
        for i, part in enumerate(s.parts):
            done = self._single(part, context, summary)
            out = done if i == 0 else union(out, done, s.unions[i - 1])
        rows, names = out
        if self.max_writes is not None and sum(summary.counts.values()) > self.max_writes:
            raise GraphError("ResourceExhausted", f"the statement writes more than {self.max_writes} things")
        if context.graph is not self.graph:
            self._store(context.graph)
        if not names:
            return Result([], None, summary=summary.counts)
        taken: dict[str, Value] = {n: rows.vars[n] for n in names}
        df = rows.df.select(*[(v.col if v.kind != "null" else F.lit(None).cast("string")).alias(n) for n, v in taken.items()])
        return Result(names, df, [str(v.type) for v in taken.values()], summary.counts)

    def _single(self, part: list[A.Node], context: Context, summary: Summary) -> tuple[Rows, list[str]]:
        rows, names = Rows.one(context), []
        for c in part:
            if isinstance(c, A.Match):
                rows = match(rows, c)
            elif isinstance(c, A.Unwind):
                rows = unwind(rows, c)
            elif isinstance(c, A.Projection):
                rows, shown = project(rows, c)
                names = shown if c.keyword == "RETURN" else []
            elif isinstance(c, A.CallProc):
                rows, names = self._call(rows, c, context)
            elif isinstance(c, A.Create):
                rows = Writer(rows, summary).create(c.paths)
            elif isinstance(c, A.Merge):
                rows = Writer(rows, summary).merge(c)
            elif isinstance(c, A.SetClause):
                rows = Writer(rows, summary).set(c.items)
            elif isinstance(c, A.Remove):
                rows = Writer(rows, summary).remove(c.items)
            elif isinstance(c, A.Delete):
                rows = Writer(rows, summary).delete(c)
            if context.rows_by_clause is not None:
                seen = Observation(uuid.uuid4().hex)
                rows = rows.copy(rows.df.observe(seen, F.count(F.lit(1)).alias("rows")))
                context.rows_by_clause.append((getattr(c, "keyword", None) or type(c).__name__.upper(), seen))
        return rows, names

    def _call(self, rows: Rows, c: A.CallProc, context: Context) -> tuple[Rows, list[str]]:
        column = C.PROCEDURES[c.name.lower()]
        values = {"label": context.graph.labels, "edgeType": context.graph.edge_types, "propertyKey": context.graph.property_keys}[column]()
        name = fresh("call")
        df = self.spark.createDataFrame([(x,) for x in values], f"{name} string")
        shown = [b or a for a, b in c.yields] if c.yields else [column]
        value = Value(F.col(name), STRING)
        out = Rows(context, df, {n: value for n in shown}) if rows.unit else rows.copy(rows.df.crossJoin(F.broadcast(df)), {**rows.vars, **{n: value for n in shown}})  # a row for each name in the catalog
        if c.where is not None:
            out.df = out.df.filter(Compiler(out).predicate(c.where))
        return out, shown

    # --------------------------------------------------------------------------------------------------- transactions
    def _store(self, graph: Graph) -> None:
        if self._open is not None:
            self._open = graph
        else:
            self._publish(graph, self._graph)

    def _publish(self, graph: Graph, base: Graph) -> None:
        """Check constraints, then make the version the current one. The first of two commits from one base wins."""
        check_constraints(graph, base)
        if self.root:
            graph = store.save(graph, self._place(), base.version)
        elif self._graph is not base:
            raise GraphError("Conflict", "another version was committed meanwhile")
        else:
            graph = graph.with_(version=base.version + 1)
        self._graph = graph

    def mark(self) -> Graph:
        """A place in the open transaction to which ``rollback_to`` goes back."""
        if self._open is None:
            raise GraphError("InvalidArgument", "no transaction is open")
        return self._open

    def rollback_to(self, mark: Graph) -> None:
        if self._open is None:
            raise GraphError("InvalidArgument", "no transaction is open")
        self._open = mark

    def import_from(self, path: str) -> None:
        """Take over the graph that ``Graph.export`` wrote; this one must be empty."""
        if self.graph.nodes or self.graph.edges:
            raise GraphError("AlreadyExists", "the graph isn't empty")
        found = store.load(self.spark, path)
        if not found.version:
            raise GraphError("NotFound", f"there is no graph at {path}")
        self._store(found.with_(version=self.graph.version))

    def _command(self, s: A.Command, params: dict) -> Result:
        kind, a = s.kind, s.args
        if kind in ("COMMIT", "ROLLBACK"):
            if self._open is None:
                raise GraphError("InvalidArgument", "no transaction is open")
            if kind == "COMMIT" and self._open is not self._base:
                self._publish(self._open, self._base)  # an error leaves the transaction open
            self._open, self._base, self._read_only = None, None, False
            return Result([], None)
        if kind == "VACUUM":
            if self._open is not None:
                raise GraphError("InvalidArgument", "a transaction is open")
            n = store.vacuum(self.spark, self._place()) if self.root else 0
            if self.root:
                self._graph = store.load(self.spark, self._place())
            return self._table(["reclaimed"], [(n,)], "reclaimed bigint")
        if kind == "ANALYZE":
            counts = self.graph.counts()
            changed = self.graph.with_(stats=counts | {"histograms": histograms(self.graph)})
            if self._open is not None:
                self._open = changed
            else:
                self._graph = changed
            return Result([], None)
        if kind == "SHOW":
            return self._show(a)
        if self._read_only:
            raise GraphError("InvalidArgument", "the transaction only reads")
        if kind in ("CREATE INDEX", "DROP INDEX", "CREATE CONSTRAINT", "DROP CONSTRAINT"):
            return self._schema(kind, a)
        if kind in ("USE", "CREATE DATABASE", "DROP DATABASE"):
            return self._databases(kind, a)
        if kind == "TERMINATE":
            raise GraphError("NotFound", f"there is no transaction {a['id']}")
        raise GraphError("Unavailable", f"{kind} needs a server")

    def _table(self, names: list[str], rows: list[tuple], schema: str) -> Result:
        return Result(names, self.spark.createDataFrame(rows, schema))

    def _schema(self, kind: str, a: dict) -> Result:
        g, summary, name = self.graph, Summary(), a["name"]
        taken = {x.name for x in (*g.indexes, *g.constraints)}
        if kind.startswith("CREATE") and name in taken:
            raise GraphError("AlreadyExists", f"{name} exists already")
        if kind == "CREATE INDEX":
            g = g.with_(indexes=(*g.indexes, Index(name, a["entity"], a["label"], tuple(a["props"]))))
            summary.add("indexes_added", 1)
        elif kind == "CREATE CONSTRAINT":
            g = g.with_(constraints=(*g.constraints, Constraint(name, a["kind"], a["entity"], a["label"], a["prop"], a.get("type"))))
            if a["kind"] == "UNIQUE":
                g = g.with_(indexes=(*g.indexes, Index(name, a["entity"], a["label"], (a["prop"],), True)))
            check_constraints(g)
            summary.add("constraints_added", 1)
        else:
            part = "indexes" if kind == "DROP INDEX" else "constraints"
            if name not in {x.name for x in getattr(g, part)} or (part == "indexes" and name in {x.name for x in g.constraints}):
                raise GraphError("NotFound", f"there is no {part[:-2] if part == 'indexes' else part[:-1]} {name}")
            g = g.with_(indexes=tuple(x for x in g.indexes if x.name != name))
            if part == "constraints":
                g = g.with_(constraints=tuple(x for x in g.constraints if x.name != name))
            summary.add(f"{part}_removed", 1)
        self._store(g)
        return Result([], None, summary=summary.counts)

    def _databases(self, kind: str, a: dict) -> Result:
        if not self.root:
            raise GraphError("Unavailable", "databases need a root folder")
        files, name = store.Files(self.spark, self.root), a["name"]
        if kind == "USE":
            if self._open is not None:
                raise GraphError("InvalidArgument", "a transaction is open")
            if name != "default" and not files.exists(name):
                raise GraphError("NotFound", f"there is no database {name}")
            self.database, self._graph = name, store.load(self.spark, self._place(name))
        elif kind == "CREATE DATABASE":
            if not DATABASE_NAME.match(name):
                raise GraphError("InvalidArgument", f"{name} can't be the name of a database")
            if name in KEPT_DATABASES or files.exists(name):
                raise GraphError("AlreadyExists", f"the database {name} exists already")
            files.mkdirs(name)
        else:
            if name in KEPT_DATABASES:
                raise GraphError("InvalidArgument", f"{name} can't be dropped")
            if not files.exists(name):
                raise GraphError("NotFound", f"there is no database {name}")
            files.mkdirs(".trash")
            files.rename(name, f".trash/{name}-{int(time.time() * 1000)}")
            if self.database == name:
                self.database, self._graph = "default", store.load(self.spark, self._place("default"))
        return Result([], None)

    def _show(self, a: dict) -> Result:
        g, what = self.graph, a["what"]
        if what == "INDEXES":
            return self._table(["name", "entity", "label", "properties", "unique", "state"], [(i.name, i.entity, i.label, list(i.props), i.unique, "online") for i in g.indexes], "name string, entity string, label string, properties array<string>, unique boolean, state string")
        if what == "CONSTRAINTS":
            return self._table(["name", "kind", "entity", "label", "property", "type"], [(c.name, c.kind, c.entity, c.label, c.prop, c.type) for c in g.constraints], "name string, kind string, entity string, label string, property string, type string")
        if what in ("LABELS", "EDGE TYPES", "PROPERTY KEYS"):
            column, values = {"LABELS": ("label", g.labels), "EDGE TYPES": ("edgeType", g.edge_types), "PROPERTY KEYS": ("propertyKey", g.property_keys)}[what]
            return self._table([column], [(x,) for x in values()], f"{column} string")
        if what == "STATS":
            counts = g.counts()
            rows = [("nodes", None, counts["nodes"]), ("edges", None, counts["edges"]), *(("label", k, n) for k, n in sorted(counts["labels"].items())), *(("type", k, n) for k, n in sorted(counts["types"].items()))]
            return self._table(["kind", "name", "count"], rows, "kind string, name string, count bigint")
        if what == "TRANSACTIONS":
            rows = [(self._transactions, "READ ONLY" if self._read_only else "READ WRITE")] if self._open is not None else []
            return self._table(["id", "mode"], rows, "id bigint, mode string")
        if what == "DATABASES" and self.root:
            names = sorted({"default", *(n for n in store.Files(self.spark, self.root).list() if not n.startswith("."))})
            return self._table(["name", "current"], [(n, n == self.database) for n in names], "name string, current boolean")
        raise GraphError("Unavailable", f"SHOW {what} needs a server")

    def _explain(self, s: A.Explain, params: dict) -> Result:
        plan = explain.lines(explain.plan(s, self.graph))
        if not s.profile:
            return self._table(["plan"], [(line,) for line in plan], "plan string")
        began, observed = time.time(), []
        result = self._query(s.query, params, observed)
        if result.df is not None:
            result.df = cut(result.df, "profiled")
        n = result.df.count() if result.df is not None else 0
        done = [f"{name}: {seen.get['rows']} rows" for name, seen in observed] if result.df is not None else []
        result.profile = [*plan, *done, f"rows: {n}, seconds: {time.time() - began:.3f}"]
        return result


# --------------------------------------------------------------------------------------------------------- constraints
def _new_rows(graph: Graph, base: Graph | None, c: Constraint) -> tuple[DataFrame, Type] | None:
    """(id, v, kind) of the rows that tables under this constraint got since base, or of all their rows; None if there are none."""
    tables = graph.node_tables([[c.label]]) if c.entity == "node" else graph.edge_tables([c.label])
    old = {id(x.df) for t in (*base.nodes, *base.edges) for x in t.deltas} if base is not None and c in base.constraints else set()
    rows = [(x.df, properties_of(x.df)) for t in tables for x in t.deltas if not x.gone and id(x.df) not in old]
    if not rows:
        return None
    kind = NULL
    for _, types in rows:
        kind = unify(kind, types.get(c.prop, NULL), f"values of the property {c.prop}")
    if kind == NULL:
        kind = STRING
    each = [df.select("id", (as_type(Value(F.col(f"`{P}{c.prop}`"), types[c.prop]), kind) if c.prop in types else null_of(kind)).alias("v"), (F.col(f"`{P}{c.prop}`")["kind"] if types.get(c.prop, NULL).kind == "any" else F.lit(types.get(c.prop, NULL).kind)).alias("kind")) for df, types in rows]
    frame = (graph.node_frame([[c.label]], []) if c.entity == "node" else graph.edge_frame([c.label], []))[0]
    found = reduce(DataFrame.unionByName, each)
    return (found.join(frame.select("id"), "id", "left_semi") if any(x.gone for t in tables for x in t.deltas) else found), kind


def check_constraints(graph: Graph, base: Graph | None = None) -> None:
    """Only rows that are new since base are checked: NOT NULL by a filter, types by their parts' schemas, UNIQUE by
    counting the label's rows that have one of the new values."""
    for c in graph.constraints:
        found = _new_rows(graph, base, c)
        if found is None:
            continue
        rows, kind = found
        broken = False
        if c.kind == "EXISTS":
            broken = not rows.filter("v IS NULL").isEmpty()
        elif c.kind == "TYPE":
            broken = not rows.filter(F.col("v").isNotNull() & (F.col("kind") != c.type.lower())).isEmpty()
        else:
            frame, types = graph.node_frame([[c.label]], [c.prop]) if c.entity == "node" else graph.edge_frame([c.label], [c.prop])
            if c.prop in types:
                values = frame.select(F.col(f"`{P}{c.prop}`").alias("v")).filter("v IS NOT NULL")
                if base is not None and c in base.constraints:
                    values = values.join(rows.select(as_type(Value(F.col("v"), kind), types[c.prop]).alias("v")).filter("v IS NOT NULL").distinct(), "v", "left_semi")
                broken = not values.groupBy("v").count().filter("count > 1").isEmpty()
        if broken:
            raise GraphError("ConstraintViolation", f"the constraint {c.name} is violated")


def histograms(graph: Graph) -> dict:
    """Equi-depth bounds of each numeric property of each label, in one pass a table."""
    out = {}
    for t in graph.nodes:
        keys = [k for k, kind in t.props.items() if kind.kind in ("int", "float")]
        if not keys:
            continue
        shares = [i / _HISTOGRAM_BUCKETS for i in range(_HISTOGRAM_BUCKETS + 1)]
        row = t.df.agg(*[F.percentile_approx(F.col(f"`{P}{k}`"), shares, 1000).alias(f"h{i}") for i, k in enumerate(keys)]).first()
        for label in t.labels:
            out |= {f"{label}.{k}": row[f"h{i}"] for i, k in enumerate(keys)}
    return out


