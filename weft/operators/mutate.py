"""CREATE, MERGE, SET, REMOVE and DELETE: rows in, a new version of the graph and rows out.

A write clause first fixes its input rows in the shared folder, so ids that it gives out never change when a plan runs
again. What it writes are deltas: new rows, changed rows and ids that are gone. A table without rows of these stays as it is.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.checkpointing import cut
from weft.errors import GraphError
from weft.functions.values import EDGE, INT, KEYS, NODE, NULL, PATH, Type, Value, as_type, bad, null_of, unify
from weft.lang import ast as A
from weft.operators.match import Matcher
from weft.plans.expressions import Compiler
from weft.plans.rows import Rows, fresh
from weft.sources.graph import Graph, P

COUNTERS = ("nodes_created", "nodes_deleted", "edges_created", "edges_deleted", "properties_set", "labels_added", "labels_removed", "indexes_added", "indexes_removed", "constraints_added", "constraints_removed")
STORABLE = {"bool", "int", "float", "string", "bytes", "date", "datetime", "duration", "list", "map", "node", "edge", "null", "any"}


@dataclass
class Summary:
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))

    def add(self, name: str, n: int) -> None:
        self.counts[name] += n


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows written down, with gapless numbers from 0 in their order, without gathering them.

    What is written holds each row's partition and place in it; numbers are the counts of the partitions before, added
    to the place. They come from data, so they are the same each time, however the files are read.
    """
    at = fresh("at")
    written = cut(df.withColumn(at, F.monotonically_increasing_id()), "rows")
    part = F.shiftright(F.col(at), 33)
    counts = written.groupBy(part.alias("_part")).count()
    offsets = counts.select("_part", (F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")).alias("_o"))
    joined = written.join(F.broadcast(offsets), part == F.col("_part"))  # a row for each partition
    return joined.withColumn(name, F.col("_o") + F.col(at) - F.shiftleft(part, 33)).drop(at, "_part", "_o")


def fixed(rows: Rows) -> tuple[Rows, str]:
    """The rows written down, with a number for each in their order."""
    number = fresh("row")
    return rows.copy(numbered(rows.df.orderBy(rows.order) if rows.order else rows.df, number)), number


def _store_type(v: Value, key: str) -> None:
    if v.kind not in STORABLE or v.type == PATH:
        bad(f"a {v.kind} can't be stored in the property {key}")


def _values(rows: Rows, props: A.MapLit | None) -> dict[str, Value]:
    out = {}
    for k, x in props.entries if props else ():
        v = Compiler(rows)(x)
        _store_type(v, k)
        if v.kind != "null":
            out[k] = Value(F.col(rows.named(v.col, "w")), v.type)
    return out


def _count_set(df: DataFrame, cols: list[str]) -> int:
    if not cols:
        return 0
    row = df.agg(*[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return sum(row)


class Writer:
    def __init__(self, rows: Rows, summary: Summary):
        self.rows, self.context, self.summary = rows, rows.context, summary

    @property
    def graph(self) -> Graph:
        return self.context.graph

    @graph.setter
    def graph(self, g: Graph) -> None:
        self.context.graph = g

    # --------------------------------------------------------------------------------------------------------- create
    def create(self, paths: list[A.Path], where: str | None = None) -> Rows:
        """Create the paths for each row; with ``where``, only for rows in which that column is true."""
        rows, number = fixed(self.rows)
        names = dict(rows.vars)
        chosen = F.lit(True) if where is None else F.col(where)
        total = rows.df.count()
        if where is not None:
            total = rows.df.filter(where).count()
            seq = fresh("seq")
            ranked = numbered(rows.df.filter(where).select(F.col(number).alias("_n")).orderBy("_n"), seq)
            rows = rows.copy(rows.df.join(ranked, F.col(number) == F.col("_n"), "left").drop("_n"))
        else:
            seq = number
        new_nodes: dict[str, tuple[list[str], dict[str, Value]]] = {}
        touched: list[tuple[A.NodePat, Value]] = []
        new_edges = []
        rows.vars = names
        self.graph = self.graph.settled()
        nodes_at, edges_at = self.graph.next_node, self.graph.next_edge
        for p in paths:
            own = []
            for x in p.parts:
                if not isinstance(x, A.NodePat):
                    own.append(None)
                    continue
                if x.name and x.name in names:
                    if x.labels or x.props:
                        touched.append((x, names[x.name]))
                    own.append(names[x.name].col)
                    continue
                cid = rows.named(F.when(chosen, F.col(seq) + nodes_at), "n")
                nodes_at += total
                props = _values(rows, x.props)
                value = Value(F.col(cid), NODE, {k: (_name_of(v), v.type) for k, v in props.items()}, extra={"id": cid, "whole": False})
                new_nodes[cid] = (sorted({n for g in x.labels for n in g}), props)
                names[x.name or fresh("anon")] = value
                rows.vars = names
                own.append(F.col(cid))
            ids: list = list(own)
            for i in range(1, len(p.parts), 2):
                r = p.parts[i]
                cid = rows.named(F.when(chosen, F.col(seq) + edges_at), "e")
                edges_at += total
                a, b = (own[i + 1], own[i - 1]) if r.direction == "in" else (own[i - 1], own[i + 1])
                src, dst = rows.named(a, "src"), rows.named(b, "dst")
                props = _values(rows, r.props)
                new_edges.append((cid, r.types[0], src, dst, props))
                ids[i] = F.col(cid)
                if r.name:
                    names[r.name] = Value(F.col(cid), EDGE, {k: (_name_of(v), v.type) for k, v in props.items()}, extra={"id": cid, "src": src, "dst": dst})
                    rows.vars = names
            if p.name:
                path = F.struct(F.array(*ids[::2]).alias("nodes"), (F.array(*ids[1::2]) if len(ids) > 1 else F.array().cast("array<bigint>")).alias("edges"))
                names[p.name] = Value(F.col(rows.named(path, "path")), PATH)
        # what the rows now hold is written once: ids, properties and ends all come from the same table
        rows = rows.copy(cut(rows.df, "created"), {k: v for k, v in names.items() if not k.startswith("_anon")})
        live = rows.df if where is None else rows.df.filter(where)
        for cid, kind, src, dst, _ in new_edges:
            if live.filter(F.col(src).isNull() | F.col(dst).isNull()).limit(1).count():
                raise GraphError("NotFound", f"an end of the {kind} relationship doesn't exist")
        graph = self.graph
        for cid, (labels, props) in new_nodes.items():
            graph = graph.append_nodes(tuple(labels), live.select(F.col(cid).alias("id"), *[v.col.alias(P + k) for k, v in props.items()]))
            self.summary.add("nodes_created", total)
            self.summary.add("labels_added", total * len(labels))
            self.summary.add("properties_set", _count_set(live, [_name_of(v) for v in props.values()]))
        for cid, kind, src, dst, props in new_edges:
            graph = graph.append_edges(kind, live.select(F.col(cid).alias("id"), F.col(src).alias("src"), F.col(dst).alias("dst"), *[v.col.alias(P + k) for k, v in props.items()]))
            self.summary.add("edges_created", total)
            self.summary.add("properties_set", _count_set(live, [_name_of(v) for v in props.values()]))
        self.graph = graph.with_(next_node=nodes_at, next_edge=edges_at)
        for x, v in touched:
            items = [A.SetItem("labels", "", labels=[n for g in x.labels for n in g])] if x.labels else []
            items += [A.SetItem("prop", "", k, e) for k, e in (x.props.entries if x.props else ())]
            rows = self._patch(rows, v, items, where)
        return rows

    # ---------------------------------------------------------------------------------------------------------- merge
    def merge(self, c: A.Merge) -> Rows:
        rows, number = fixed(self.rows)
        parts = c.path.parts
        bound = {x.name for x in parts if x.name in rows.vars}
        # keys: the pattern's property values and bound nodes, the same for rows that want the same thing
        keys, swapped = [], []
        work = rows
        for x in parts:
            entries = []
            for k, e in x.props.entries if x.props else ():
                v = Compiler(work)(e)
                _store_type(v, k)
                name = fresh("key")
                col = work.named(v.col if v.kind != "null" else F.lit(None).cast("string"), "mk")
                keys.append((name, col, v.type))
                entries.append((k, A.Var(name)))
            y = type(x)(**{**{f: getattr(x, f) for f in x.__dataclass_fields__}, "props": A.MapLit(entries) if entries else None})
            if y.name is None:
                y.name = fresh("anon")
            swapped.append(y)
        columns = [c2 for _, c2, _ in keys] + [work.named(work.vars[n].col, "mk") for n in sorted(bound)]
        work.df = cut(work.df, "merge")
        if bound and work.df.filter(reduce(lambda a, b: a | b, [work.vars[n].col.isNull() for n in bound])).limit(1).count():
            bad("MERGE from a node that is null")
        distinct = work.df.select(*columns).distinct() if columns else work.context.spark.range(1).select(F.lit(1).alias("_one"))
        if not columns:
            columns = ["_one"]
            work.df = work.df.withColumn("_one", F.lit(1))
        inner_names = {n: Value(F.col(col), t) for n, col, t in keys}
        inner_names |= {n: Value(F.col(col), work.vars[n].type, extra={"id": col}) for n, col in zip(sorted(bound), columns[len(keys) :], strict=False)}
        seed = Rows(self.context, distinct, inner_names)
        if not distinct.columns or columns == ["_one"]:
            seed.unit = False
        found = Matcher(seed, [A.Path(None, swapped)], None).run()
        fresh_names = [x.name for x in swapped if x.name not in bound and x.name in found.vars] + [x.name for x in swapped if x.name not in bound and x.name not in found.vars]
        anon = {x.name for x in swapped if x.name.startswith("_anon")}
        sort_cols = [found.vars[x.name].col for x in swapped if x.name in found.vars and isinstance(x, A.RelPat)] + [found.vars[x.name].col for x in swapped if x.name in found.vars and isinstance(x, A.NodePat) and x.name not in bound]
        best_name = fresh("best")
        hits_of = [x for x in swapped if x.name not in bound and x.name in found.vars]
        order = [c2.alias(f"s{i}") for i, c2 in enumerate(sort_cols)] or [F.lit(1).alias("s0")]
        pick = F.struct(*order, *[found.vars[x.name].col.alias(f"v{i}") for i, x in enumerate(hits_of)])
        best = cut(found.df.groupBy(*columns).agg(F.min(pick).alias(best_name)), "hits")
        cond = reduce(lambda a, b: a & b, [work.df[k].eqNullSafe(best[k]) for k in columns])
        joined = work.df.join(best, cond, "left").select(*[work.df[x] for x in work.df.columns], best[best_name])
        hit = F.col(best_name).isNotNull()
        any_null = reduce(lambda a, b: a | b, [F.col(col).isNull() for _, col, _ in keys], F.lit(False))
        first = F.row_number().over(Window.partitionBy(*columns).orderBy(number)) == 1
        creates, leader = fresh("creates"), fresh("leader")
        joined = joined.withColumn(creates, ~hit & (any_null | first))
        joined = joined.withColumn(leader, F.when(~hit & ~any_null, F.min(number).over(Window.partitionBy(*columns))))
        state = rows.copy(cut(joined, "merged"), dict(rows.vars))
        create_parts = []
        for x, original in zip(swapped, parts, strict=True):
            y = type(original)(**{f: getattr(original, f) for f in original.__dataclass_fields__})
            y.name = original.name or x.name
            if isinstance(y, A.NodePat) and y.name in bound:
                y.labels, y.props = [], None
            create_parts.append(y)
        maker = Writer(state, self.summary)
        made = maker.create([A.Path(None, create_parts)], creates)
        # ids: of the match, of what the row made, or of what the first row with the same key made
        out_names = dict(rows.vars)
        made_cols = {x.name: _name_of(made.vars[x.name]) if x.name in made.vars else None for x in create_parts}
        visible = [x for x in create_parts if x.name not in bound and made_cols.get(x.name)]
        at, led = fresh("lead"), [fresh("led") for _ in visible]
        lead = made.df.filter(creates).select(F.col(number).alias(at), *[F.col(made_cols[x.name]).alias(n) for n, x in zip(led, visible, strict=True)])
        df = made.df.join(lead, F.col(leader) == F.col(at), "left").drop(at)
        hit_at = {x.name: i for i, x in enumerate(hits_of)}
        for i, x in enumerate(visible):
            col = fresh("m")
            from_hit = F.col(best_name)[f"v{hit_at[x.name]}"] if x.name in hit_at else F.lit(None).cast("bigint")
            df = df.withColumn(col, F.coalesce(from_hit, F.col(made_cols[x.name]), F.col(led[i])))
            if x.name not in anon:
                out_names[x.name] = Value(F.col(col), NODE if isinstance(x, A.NodePat) else EDGE, extra={"id": col})
        result = rows.copy(cut(df, "merge-out"), out_names)
        if c.path.name:
            every = [out_names[x.name].col for x in create_parts if x.name in out_names]
            result.vars[c.path.name] = Value(F.col(result.named(F.struct(F.array(*every[::2]).alias("nodes"), (F.array(*every[1::2]) if len(every) > 1 else F.array().cast("array<bigint>")).alias("edges")), "path")), PATH)
        matched = fresh("matched")
        result.df = result.df.withColumn(matched, ~F.col(creates))
        for items, only in ((c.on_create, creates), (c.on_match, matched)):
            for name, own in _by_name(items):
                result = self._patch(result, result.vars[name], own, only, number)
        del fresh_names
        return result

    # ------------------------------------------------------------------------------------------------------ set, remove
    def set(self, items: list[A.SetItem]) -> Rows:
        rows, number = fixed(self.rows)
        for name, own in _by_name(items):
            v = rows.check(name)
            if v.kind not in ("node", "edge", "null"):
                bad(f"SET of a {v.kind}")
            if v.kind != "null":
                rows = self._patch(rows, v, own, None, number)
        return rows

    def remove(self, items: list[A.SetItem]) -> Rows:
        rows, number = fixed(self.rows)
        for name, own in _by_name(items):
            v = rows.check(name)
            if v.kind != "null":
                cleared = [A.SetItem("prop", name, i.key, A.Lit(None)) if i.kind == "prop" else A.SetItem("drop", name, labels=i.labels) for i in own]
                rows = self._patch(rows, v, cleared, None, number)
        return rows

    def _patch(self, rows: Rows, v: Value, items: list[A.SetItem], only: str | None, number: str | None = None) -> Rows:
        """Apply items to the entities of one variable; of several rows with one entity the last one counts."""
        work = rows.copy(rows.df, dict(rows.vars))
        writes: dict[str, Value | None] = {}
        replace_all, add, drop = False, [], []
        fields: dict[str, Type] = {}
        for i in items:
            if i.kind == "labels":
                add += i.labels
            elif i.kind == "drop":
                drop += i.labels
            elif i.kind == "prop":
                x = Compiler(work)(i.value)
                _store_type(x, i.key)
                writes[i.key] = Value(F.col(work.named(x.col if x.kind != "null" else F.lit(None).cast("string"), "w")), x.type)
            else:
                x = Compiler(work)(i.value)
                if i.kind == "replace":
                    replace_all, writes = True, {}
                if x.kind in ("node", "edge"):
                    x = work.entity_properties(x)
                if x.kind == "null" and i.kind == "replace":
                    continue
                if x.kind != "map":
                    bad(f"properties from a {x.kind}")
                if i.kind != "replace" and KEYS in dict(x.type.fields):
                    bad("SET += takes maps of one shape in all rows")
                for k, t in x.type.fields:
                    if k == KEYS:
                        continue
                    _store_type(Value(x.col, t), k)
                    writes[k] = Value(F.col(work.named(x.col[k] if t.kind != "null" else F.lit(None).cast("string"), "w")), t)
        del fields
        target = work.named(v.col, "t")
        df = work.df.filter(F.col(target).isNotNull())
        if only is not None:
            df = df.filter(only)
        order = F.col(number) if number else F.monotonically_increasing_id()
        packed = F.struct(order.alias("o"), *[x.col.alias(f"w{i}") for i, x in enumerate(writes.values())])
        patches = cut(df.groupBy(F.col(target).alias("id")).agg(F.max(packed).alias("w")), "patch")
        if patches.isEmpty():
            return rows
        if v.kind == "node":
            self.graph = self._patch_nodes(patches, writes, replace_all, add, drop, v.extra.get("sets"))
        else:
            self.graph = self._patch_edges(patches, writes, replace_all, v.extra.get("types"))
        # names that carried properties read them anew
        names = {}
        for k, x in rows.vars.items():
            names[k] = Value(x.col, x.type, None, extra={e: c for e, c in x.extra.items() if e in ("id", "src", "dst", "type")}) if x.kind in ("node", "edge") else x
        return rows.copy(rows.df, names)

    def _patched(self, table, patches: DataFrame, writes: dict[str, Value | None], replace_all: bool) -> tuple[DataFrame, int, int]:
        """The table's rows that patches change, as they are then; how many, and how many values were set."""
        own = table.props
        joined = table.df.join(patches.select("id", F.col("w").alias("_p")), "id")
        cols, changed = [], []
        lead = [c for c in table.df.columns if c in ("id", "src", "dst")]
        for k in dict.fromkeys([*own, *writes]):
            if k in writes:
                i, t = list(writes).index(k), writes[k].type
                whole = unify(own.get(k, NULL), t, f"values of the property {k}")
                if whole.kind == "null":
                    continue
                new = as_type(Value(F.col("_p")[f"w{i}"], t), whole)
                old = as_type(Value(F.col(f"`{P}{k}`"), own[k]), whole) if k in own else null_of(whole)
                cols.append(new.alias(P + k))
                changed.append(new.isNotNull() | old.isNotNull())
            elif replace_all:
                cols.append(null_of(own[k]).alias(P + k))
                changed.append(F.col(f"`{P}{k}`").isNotNull())
            else:
                cols.append(F.col(f"`{P}{k}`"))
        total = reduce(lambda a, b: a + b, [c.cast("int") for c in changed], F.lit(0))
        rows = cut(joined.select(*lead, *cols, total.alias("_set")), "patched")
        n, values = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_set"), F.lit(0))).first()
        return rows.drop("_set"), n, values

    def _patch_nodes(self, patches, writes, replace_all, add, drop, sets) -> Graph:
        """sets: label sets of the tables that the nodes are from, if the pattern that bound them tells."""
        graph, moves = self.graph, []
        kept = list(graph.nodes)
        for i, t in enumerate(graph.nodes):
            if sets is not None and t.labels not in sets:
                continue
            rows, n, values = self._patched(t, patches, writes, replace_all)
            if not n:
                continue
            self.summary.add("properties_set", values)
            labels = tuple(sorted((set(t.labels) | set(add)) - set(drop)))
            if labels == t.labels:
                kept[i] = t.changed(rows)
                continue
            self.summary.add("labels_added", n * len(set(add) - set(t.labels)))
            self.summary.add("labels_removed", n * len(set(drop) & set(t.labels)))
            kept[i] = t.without(rows.select("id"))
            moves.append((labels, rows))
        graph = graph.with_(nodes=tuple(kept))
        for labels, rows in moves:
            graph = graph.append_nodes(labels, rows)
        return unsure(graph, drop)

    def _patch_edges(self, patches, writes, replace_all, types) -> Graph:
        kept = list(self.graph.edges)
        for i, t in enumerate(self.graph.edges):
            if types and t.type not in types:
                continue
            rows, n, values = self._patched(t, patches, writes, replace_all)
            if n:
                self.summary.add("properties_set", values)
                kept[i] = t.changed(rows)
        return self.graph.with_(edges=tuple(kept))

    # --------------------------------------------------------------------------------------------------------- delete
    def delete(self, c: A.Delete) -> Rows:
        rows, _ = fixed(self.rows)
        nodes, edges, sets, types = [], [], set(), set()
        for x in c.items:
            v = Compiler(rows)(x)
            if v.kind not in ("node", "edge", "null"):
                bad(f"DELETE of a {v.kind}")
            if v.kind != "null":
                col = rows.named(v.col, "del")
                (nodes if v.kind == "node" else edges).append(col)
                if v.kind == "node":  # tables that the nodes may be from: all, if a pattern doesn't tell
                    sets |= {t.labels for t in self.graph.nodes} if v.extra.get("sets") is None else set(v.extra["sets"])
                else:
                    types |= set(v.extra.get("types") or [t.type for t in self.graph.edges])
        ids = lambda cols: cut(reduce(lambda a, b: a.unionByName(b), [rows.df.select(F.col(k).alias("id")) for k in cols]).filter("id is not null").distinct(), "gone") if cols else None
        gone_nodes, gone_edges = ids(nodes), ids(edges)
        graph, kept = self.graph, []
        touches = lambda wanted: wanted is None or any(set(w) <= set(labels) for w in wanted for labels in sets)
        for t in graph.edges:
            sides = [x for x, wanted in (("src", t.src_labels), ("dst", t.dst_labels)) if gone_nodes is not None and touches(wanted)]
            at = [t.df.join(gone_nodes.withColumnRenamed("id", x), x, "left_semi").select("id") for x in sides]
            at_node = reduce(DataFrame.unionByName, at) if at else None
            found = [x for x in (t.df.select("id").join(gone_edges, "id", "left_semi") if gone_edges is not None and t.type in types else None, at_node if c.detach else None) if x is not None]
            table, n = _without(t, reduce(DataFrame.unionByName, found).distinct()) if found else (t, 0)
            self.summary.add("edges_deleted", n)
            kept.append(table)
            if at_node is not None and not c.detach and not (at_node if gone_edges is None else at_node.join(gone_edges, "id", "left_anti")).isEmpty():
                raise GraphError("ConstraintViolation", "a node that still has relationships can't be deleted")
        graph = graph.with_(edges=tuple(kept))
        if gone_nodes is not None:
            tables = []
            for t in graph.nodes:
                if t.labels not in sets:
                    tables.append(t)
                    continue
                table, n = _without(t, t.df.select("id").join(gone_nodes, "id", "left_semi"))
                self.summary.add("nodes_deleted", n)
                tables.append(table)
            graph = graph.with_(nodes=tuple(tables))
        self.graph = graph
        return rows


def _without(table, ids: DataFrame):
    """The table without these ids, which it has, and how many they are; the same table if there are none."""
    gone = cut(ids, "gone")
    n = gone.count()
    return (table.without(gone), n) if n else (table, 0)


def _name_of(v: Value) -> str:
    return v.extra["id"] if "id" in v.extra else v.col._jc.toString()


def _by_name(items: list[A.SetItem]) -> list[tuple[str, list[A.SetItem]]]:
    """Runs of items of one name, in order."""
    out: list[tuple[str, list[A.SetItem]]] = []
    for i in items:
        if out and out[-1][0] == i.name:
            out[-1][1].append(i)
        else:
            out.append((i.name, [i]))
    return out


def unsure(graph: Graph, dropped: list[str]) -> Graph:
    """Where nodes lose a label, edge tables can't vouch for it any more."""
    lost = lambda sets: sets is not None and any(x in s for s in sets for x in dropped)
    if not any(lost(t.src_labels) or lost(t.dst_labels) for t in graph.edges):
        return graph
    return graph.with_(edges=tuple(replace(t, src_labels=None if lost(t.src_labels) else t.src_labels, dst_labels=None if lost(t.dst_labels) else t.dst_labels) for t in graph.edges))


__all__ = ["INT", "Summary", "Writer"]
