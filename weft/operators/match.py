"""Pattern matching as joins.

A pattern is a graph of node variables and relationships. Matching begins at what is already bound, or at the most
selective node, and joins one relationship after the other at a bound end; a node table is joined only if something of
the node is read that the edges don't guarantee. Parts of a pattern without connection are built on their own and
crossed at the end, below the filter, so Catalyst turns equalities between them into keys of an inner join.
"""

from __future__ import annotations

import copy
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.errors import GraphError
from weft.functions.values import EDGE, NODE, PATH, STRING, Value, bad, list_of
from weft.lang import ast as A
from weft.operators import paths
from weft.plans.expressions import Compiler, compare, conjuncts, free
from weft.plans.rows import Rows, fresh
from weft.sources.graph import NATIVE, P


def bind_node(rows: Rows, frame: DataFrame, types: dict) -> tuple[DataFrame, Value]:
    """Rename a node frame's columns to generated ones."""
    cid, labels = fresh("n"), fresh("labels")
    props = {k: (fresh("p"), t) for k, t in types.items()}
    native = _native(frame, types)
    df = frame.select(F.col("id").alias(cid), F.col("labels").alias(labels), *[F.col(f"`{P}{k}`").alias(c) for k, (c, _) in props.items()], *[F.col(f"`{NATIVE}{k}`").alias(c) for k, c in native.items()])
    return df, Value(F.col(cid), NODE, props, extra={"id": cid, "labels": labels, "whole": True, "native": native})


def bind_edge(frame: DataFrame, types: dict) -> tuple[DataFrame, Value]:
    names = {k: fresh(k) for k in ("id", "src", "dst", "type")}
    props = {k: (fresh("p"), t) for k, t in types.items()}
    native = _native(frame, types)
    df = frame.select(*[F.col(k).alias(c) for k, c in names.items()], *[F.col(f"`{P}{k}`").alias(c) for k, (c, _) in props.items()], *[F.col(f"`{NATIVE}{k}`").alias(c) for k, c in native.items()])
    return df, Value(F.col(names["id"]), EDGE, props, extra={**names, "whole": True, "native": native})


def _native(frame: DataFrame, types: dict) -> dict[str, str]:
    return {k: fresh("t") for k in types if NATIVE + k in frame.columns}


def _label_condition(labels: str, groups: list[list[str]]) -> Column | None:
    each = [reduce(lambda a, b: a | b, [F.array_contains(labels, x) for x in g]) for g in groups]
    return reduce(lambda a, b: a & b, each) if each else None


class Matcher:
    def __init__(self, rows: Rows, patterns: list[A.Path], where: A.Node | None):
        self.rows, self.context = rows, rows.context
        self.graph = self.context.graph
        self.pending = conjuncts(where)
        self.conditional = where is not None
        self.paths = patterns
        self.nodes: dict[str, list[A.NodePat]] = {}
        self.rels: list[tuple[A.RelPat, str, str, str]] = []  # pattern, own name, left, right
        self.named: dict[int, list[str]] = {}  # of each path: names of its parts in turn
        self.anonymous: list[str] = []
        self.uses: list[tuple[str, tuple[str, ...], bool]] = []  # relationship names, types, whether a list
        for p in patterns:
            if p.shortest:
                continue
            names = [self._name(x) for x in p.parts]
            self.named[id(p)] = names
            for x, n in zip(p.parts, names, strict=True):
                if isinstance(x, A.NodePat):
                    self.nodes.setdefault(n, []).append(x)
            for i in range(1, len(names), 2):
                self.rels.append((p.parts[i], names[i], names[i - 1], names[i + 1]))

    def _name(self, x) -> str:
        if x.name:
            return x.name
        name = fresh("anon")
        self.anonymous.append(name)
        return name

    # -------------------------------------------------------------------------------------------------------- the plan
    def run(self) -> Rows:
        parts = self._components()
        base = [c for c in parts if any(n in self.rows.vars for n in c)]
        rows = self.rows
        for c in base:
            rows = self._grow(rows, c)
        for c in parts:
            if c in base:
                continue
            own = self._grow(None, c)
            joined = own if rows.unit else rows.copy(rows.df.crossJoin(own.df), {**rows.vars, **own.vars})
            joined.order = rows.order
            rows = self._filtered(joined)
        for p in self.paths:
            if p.shortest:
                rows = self._shortest(rows, p)
        rows = self._isomorphic(rows)
        rows = self._filtered(rows, True)
        for p in self.paths:
            if p.name and not p.shortest:
                rows = self._path(rows, p)
        kept = {k: v for k, v in rows.vars.items() if k not in self.anonymous}
        out = rows.copy(names=kept)
        only = self.paths[0].parts if len(self.paths) == 1 else ()
        out.bare = self.rows.unit and len(only) == 1 and not only[0].props and not self.conditional
        return out

    def _components(self) -> list[list[str]]:
        group = {n: {n} for n in self.nodes}
        joined = [(a, b) for _, _, a, b in self.rels]
        bound = [n for n in self.nodes if n in self.rows.vars]
        joined += list(zip(bound, bound[1:], strict=False))
        by_rel: dict[str, str] = {}
        for r, name, a, _ in self.rels:
            if name in by_rel:
                joined.append((by_rel[name], a))
            by_rel[name] = a
            if r.name in self.rows.vars and bound:
                joined.append((a, bound[0]))
        for a, b in joined:
            if group[a] is not group[b]:
                group[a] |= group[b]
                for n in group[b]:
                    group[n] = group[a]
        out, seen = [], set()
        for n in self.nodes:
            if n not in seen:
                seen |= group[n]
                out.append([m for m in self.nodes if m in group[n]])
        return out

    def _score(self, name: str) -> tuple:
        """Smaller is more selective."""
        equalities = sum(1 for c in self.pending if isinstance(c, A.Binary) and c.op == "=" and free(c) == {name})
        ranges = sum(1 for c in self.pending if free(c) == {name})
        has_props = any(p.props and p.props.entries for p in self.nodes[name])
        labelled = any(p.labels for p in self.nodes[name])
        counts = self.graph.stats.get("labels", {})
        size = min((counts.get(g[0], 1 << 60) for p in self.nodes[name] for g in p.labels), default=1 << 61)
        return (-(equalities > 0 or has_props), -(ranges > 0), -labelled, size, list(self.nodes).index(name))

    def _grow(self, rows: Rows | None, component: list[str]) -> Rows:
        todo = [r for r in self.rels if r[2] in component]
        if rows is None:
            start = min(component, key=self._score)
            rows = self._scan(start)
        for n in component:
            if n in rows.vars and n in self.rows.vars:
                rows = self._restrict(rows, n)
        rows = self._filtered(rows)
        while todo:
            ready = [r for r in todo if r[2] in rows.vars or r[3] in rows.vars]
            if not ready:  # a bound part elsewhere in the same component; begin another arm and cross
                name = min((n for n in component if n not in rows.vars), key=self._score)
                own = self._scan(name)
                rows = self._filtered(rows.copy(rows.df.crossJoin(own.df), {**rows.vars, **own.vars}))
                continue
            both = [r for r in ready if r[2] in rows.vars and r[3] in rows.vars]
            fixed = [r for r in both or ready if r[0].length is None]
            pick = (fixed or both or ready)[0]
            todo.remove(pick)
            rows = self._filtered(self._walk(rows, *pick) if pick[0].length else self._hop(rows, *pick))
        for n in component:
            if n not in rows.vars:
                own = self._scan(n)
                rows = self._filtered(rows.copy(rows.df.crossJoin(own.df), {**rows.vars, **own.vars}))
        return rows

    # -------------------------------------------------------------------------------------------------------- filters
    def _filtered(self, rows: Rows, rest: bool = False) -> Rows:
        """Apply the conditions whose names are all bound; a set of simple ones at once."""
        later = []
        for c in self.pending:
            if rest or free(c) <= set(rows.vars):
                compiled = Compiler(rows).predicate(c)
                rows.df = rows.df.filter(compiled)
            else:
                later.append(c)
        self.pending = later
        return rows

    def _props(self, rows: Rows, v: Value, props: A.MapLit | None) -> Rows:
        for k, x in props.entries if props else ():
            compiler = Compiler(rows)
            have = compiler.property(v, k)
            rows.df = rows.df.filter(compare("=", have, compiler(x)).col)
        return rows

    def _groups(self, name: str) -> list[list[str]]:
        return [g for p in self.nodes[name] for g in p.labels]

    def _scan(self, name: str) -> Rows:
        frame, types = self.graph.node_frame(self._groups(name))
        df, v = bind_node(self.rows, frame, types)
        v.extra["sets"] = [t.labels for t in self.graph.node_tables(self._groups(name))]
        rows = Rows(self.context, df, {name: v})
        for p in self.nodes[name]:
            if all(not free(x) - {name} for _, x in (p.props.entries if p.props else ())):
                rows = self._props(rows, v, p.props)
            else:
                self._defer(name, p.props)
        return self._filtered(rows)

    def _defer(self, name: str, props: A.MapLit | None) -> None:
        """A property map that reads other variables becomes a condition for later."""
        for k, x in props.entries if props else ():
            self.pending.append(A.Binary("=", A.Prop(A.Var(name), k), x))

    def _restrict(self, rows: Rows, name: str) -> Rows:
        """Labels and properties that a pattern asks of a node that is bound already."""
        v = rows.vars[name]
        if v.kind == "null":
            rows.df = rows.df.filter(F.lit(False))
            return rows
        if v.kind != "node":
            raise GraphError("Semantic", f"{name} is not a node")
        groups = self._groups(name)
        if groups:
            labels = v.extra.get("labels") or rows.named(rows.entity_field(v, "labels"), "labels")
            rows.df = rows.df.filter(_label_condition(labels, groups))
        for p in self.nodes[name]:
            self._defer(name, p.props)
        rows.df = rows.df.filter(v.col.isNotNull())
        return rows

    # ----------------------------------------------------------------------------------------------------------- hops
    def _edges(self, rel: A.RelPat, whole: bool = True) -> tuple[DataFrame, dict]:
        return self.graph.edge_frame(rel.types, None if whole else [])

    def _oriented(self, df: DataFrame, v: Value, rel: A.RelPat, left: str, right: str) -> DataFrame:
        """Edge rows with the columns left and right; both ways if the pattern has no direction, a loop once."""
        src, dst = v.extra["src"], v.extra["dst"]
        out = df.withColumns({left: F.col(src), right: F.col(dst)})
        back = df.withColumns({left: F.col(dst), right: F.col(src)})
        if rel.direction == "out":
            return out
        return back if rel.direction == "in" else out.unionByName(back.filter(F.col(src) != F.col(dst)))

    def _implied(self, rel: A.RelPat, name: str, right: bool) -> bool:
        """Whether the edge tables guarantee that this end exists and has the labels asked for."""
        groups = self._groups(name)
        for t in self.graph.edge_tables(rel.types):
            ends = [t.dst_labels if right == (rel.direction == "out") else t.src_labels] if rel.direction != "both" else [t.src_labels, t.dst_labels]
            for sets in ends:
                if sets is None or not all(any(x in s for x in g) for g in groups for s in sets):
                    return False
        return True

    def _hop(self, rows: Rows, rel: A.RelPat, name: str, a: str, b: str) -> Rows:
        frame, types = self._edges(rel)
        df, v = bind_edge(frame, types)
        left, right = fresh("l"), fresh("r")
        oriented = self._oriented(df, v, rel, left, right)
        v.extra["types"] = rel.types
        known = rel.name in rows.vars
        own = Rows(self.context, oriented, {})
        for k, x in rel.props.entries if rel.props else ():
            if free(x):
                self.pending.append(A.Binary("=", A.Prop(A.Var(name), k), x))
            else:
                compiler = Compiler(own)
                own.df = own.df.filter(compare("=", compiler.property(v, k), compiler(x)).col)
        cond, new = [], []
        for end, col in ((a, left), (b, right)):
            if end in rows.vars:
                cond.append(rows.vars[end].col == F.col(col))
            else:
                new.append((end, col))
        if known:
            cond.append(rows.vars[rel.name].col == v.col)
        out = rows.copy(rows.df.join(own.df, reduce(lambda x, y: x & y, cond)), {**rows.vars, **({} if known else {name: v})})
        if a == b and new:  # a loop on a node that this hop binds
            out.df = out.df.filter(F.col(left) == F.col(right))
            new = new[:1]
        for end, col in new:
            out = self._bind_end(out, rel, end, col, end == b)
        self.uses.append((name, tuple(rel.types), False))
        return out

    def _bind_end(self, rows: Rows, rel: A.RelPat, name: str, col: str, right: bool) -> Rows:
        pats = self.nodes[name]
        read = name in self.context.needed or any(p.props for p in pats)
        if not read and self._implied(rel, name, right):
            return rows.copy(names={**rows.vars, name: Value(F.col(col), NODE, extra={"id": col})})
        df, v = bind_node(rows, *self.graph.node_frame(self._groups(name)))
        v.extra["sets"] = [t.labels for t in self.graph.node_tables(self._groups(name))]
        own = Rows(self.context, df, {name: v})
        for p in pats:
            if all(not free(x) for _, x in (p.props.entries if p.props else ())):
                own = self._props(own, v, p.props)
            else:
                self._defer(name, p.props)
        own = self._filtered(own)
        return rows.copy(rows.df.join(own.df, F.col(col) == v.col), {**rows.vars, name: v})

    def _walk(self, rows: Rows, rel: A.RelPat, name: str, a: str, b: str) -> Rows:
        """A relationship of variable length; the name is the list of edges in the order of the walk from a to b."""
        reverse = a not in rows.vars
        start, end = (b, a) if reverse else (a, b)
        frame, types = self._edges(rel)
        df, v = bind_edge(frame, types)
        own = Rows(self.context, df, {})
        for k, x in rel.props.entries if rel.props else ():
            if free(x):
                bad("the property map of a relationship of variable length takes constants")
            compiler = Compiler(own)
            own.df = own.df.filter(compare("=", compiler.property(v, k), compiler(x)).col)
        left, right = ("v", "u") if reverse else ("u", "v")
        steps = self._oriented(own.df, v, rel, left, right).select("u", "v", v.col.alias("e"))
        starts = rows.df.select(rows.vars[start].col.alias("start")).filter("start is not null").distinct()
        found = paths.walks(starts, steps, rel.length[0], rel.length[1], self.context.max_hops)
        cs, cn, ce, cx = fresh("s"), fresh("e"), fresh("es"), fresh("ns")
        edges, nodes = (F.reverse("edges"), F.reverse("nodes")) if reverse else (F.col("edges"), F.col("nodes"))
        # between: nodes of the walk from a to b, both ends left out
        between = F.slice(nodes, 2, F.size(nodes) - 1) if reverse else F.slice(nodes, 1, F.size(nodes) - 1)
        found = found.select(F.col("start").alias(cs), F.col("node").alias(cn), edges.alias(ce), between.alias(cx))
        cond = rows.vars[start].col == F.col(cs)
        if end in rows.vars:
            cond = cond & (rows.vars[end].col == F.col(cn))
        value = Value(F.col(ce), list_of(EDGE), extra={"between": cx})
        out = rows.copy(rows.df.join(found, cond), {**rows.vars, name: value})
        if end not in rows.vars:
            if start == end:
                out.df = out.df.filter(F.col(cs) == F.col(cn))
            else:
                out = self._bind_end(out, rel, end, cn, end == b)
        self.uses.append((name, tuple(rel.types), True))
        return out

    # --------------------------------------------------------------------------------------------------- what follows
    def _isomorphic(self, rows: Rows) -> Rows:
        """No stored edge twice in one MATCH: only pairs of relationships that can share an edge are compared."""
        for (n1, t1, many1), (n2, t2, many2) in combinations(self.uses, 2):
            if n1 == n2 or (t1 and t2 and not set(t1) & set(t2)):
                continue
            a, b = rows.vars[n1].col, rows.vars[n2].col
            if many1 and many2:
                rows.df = rows.df.filter(~F.arrays_overlap(a, b))
            elif many1 or many2:
                rows.df = rows.df.filter(~F.array_contains(a, b) if many1 else ~F.array_contains(b, a))
            else:
                rows.df = rows.df.filter(a != b)
        return rows

    def _path(self, rows: Rows, p: A.Path) -> Rows:
        names = self.named[id(p)]
        nodes, edges = [], []
        for i, n in enumerate(names):
            v = rows.vars[n]
            if i % 2 == 0:
                nodes.append(F.array(v.col))
            elif v.kind == "list":
                edges.append(v.col)
                nodes.append(F.col(v.extra["between"]))
            else:
                edges.append(F.array(v.col))
        none = F.array().cast("array<bigint>")
        col = rows.named(F.struct(F.concat(*nodes).alias("nodes"), (F.concat(*edges) if edges else none).alias("edges")), "path")
        return rows.copy(names={**rows.vars, p.name: Value(F.col(col), PATH)})

    def _shortest(self, rows: Rows, p: A.Path) -> Rows:
        left, rel, right = p.parts
        for n in (left, right):
            if n.name not in rows.vars:
                raise GraphError("Semantic", "the ends of a shortest path are bound before", *p.pos)
        ca, cb = rows.named(rows.vars[left.name].col, "a"), rows.named(rows.vars[right.name].col, "b")
        df, v = bind_edge(*self._edges(rel))
        steps = self._oriented(df, v, rel, "u", "v").select("u", "v", v.col.alias("e"))
        pairs = rows.df.select(F.col(ca).alias("a"), F.col(cb).alias("b")).filter("a is not null and b is not null").distinct()
        least, most = rel.length or (1, 1)
        every = p.shortest == "allShortestPaths"
        found = paths.shortest(pairs, steps, every, self.context.max_hops, least, most)
        out = fresh("sp")
        found = found.select(F.col("a").alias(ca), F.col("b").alias(cb), F.struct("nodes", "edges").alias(out))
        joined = rows.df.join(found, [ca, cb], "left")
        edges = F.col(out)["edges"]
        if every:  # no path is an empty list, which this column holds as a path of nothing; its relationships are null
            nothing = F.array().cast("array<bigint>")
            shown, listed = fresh("sp"), fresh("es")
            joined = joined.withColumns({shown: F.coalesce(F.col(out), F.struct(nothing.alias("nodes"), nothing.alias("edges"))), listed: edges})
            out, edges = shown, F.col(listed)
        names = dict(rows.vars)
        if p.name:
            names[p.name] = Value(F.col(out), PATH)
        if rel.name:
            names[rel.name] = Value(edges, list_of(EDGE))
        return rows.copy(joined, names)


def match(rows: Rows, clause: A.Match) -> Rows:
    if not clause.optional:
        return Matcher(rows, clause.paths, clause.where).run()
    return _optional(rows, clause)


def _apart(paths: list[A.Path], outside: set[str], needed: set[str]) -> tuple[list[A.Path], list[A.Node], list[str]]:
    """The paths without property maps' entries that read outside names, these as conditions, and names given for them."""
    out, conditions, given = [], [], []
    for p in paths:
        parts = []
        for x in p.parts:
            if x.props and any(free(e) & outside for _, e in x.props.entries):
                x = copy.copy(x)
                if not x.name:
                    x.name = fresh("anon")
                    given.append(x.name)
                needed.add(x.name)
                conditions += [A.Binary("=", A.Prop(A.Var(x.name), k), e) for k, e in x.props.entries if free(e) & outside]
                x.props = A.MapLit([(k, e) for k, e in x.props.entries if not free(e) & outside])
            parts.append(x)
        p = copy.copy(p)
        p.parts = parts
        out.append(p)
    return out, conditions, given


def _renamed(paths: list[A.Path], old: str, new: str) -> list[A.Path]:
    out = []
    for p in paths:
        p = copy.copy(p)
        p.parts = [copy.copy(x) for x in p.parts]
        for x in p.parts:
            if x.name == old:
                x.name = new
        out.append(p)
    return out


def _optional(rows: Rows, clause: A.Match) -> Rows:
    """Left outer join: the pattern from the distinct shared nodes on, and the condition in the join.

    Where the rows are all nodes of some labels, nothing is gained by beginning at them, and the rows would be worked out
    twice: then the pattern is matched by itself and joined by the shared node.
    """
    if any(p.shortest for p in clause.paths):
        return Matcher(rows, clause.paths, clause.where).run()
    names = {x.name for p in clause.paths for x in p.parts if x.name}
    shared = [n for n in rows.vars if n in names]
    outside = set(rows.vars) - set(shared)
    patterns, joint, given = _apart(clause.paths, outside, rows.context.needed)
    parts = conjuncts(clause.where)
    mine = [c for c in parts if not free(c) & outside]
    joint += [c for c in parts if free(c) & outside]
    where = reduce(lambda a, b: A.Binary("AND", a, b), mine) if mine else None
    keys = {n: fresh("k") for n in shared}
    left = rows
    for n in shared:
        left.df = left.df.withColumn(keys[n], rows.vars[n].col)
    alone = rows.bare and len(shared) == 1 and not any(shared[0] in free(c) for c in mine) and any(len(p.parts) > 1 for p in patterns) and not any(x.props for p in patterns for x in p.parts if x.name == shared[0])
    if alone:
        own = fresh("anon")
        right = Matcher(Rows.one(rows.context), _renamed(patterns, shared[0], own), where).run()
        inner = {shared[0]: right.named(right.vars.pop(own).col, "i")}
    elif shared:
        seed_df = left.df.select(*keys.values()).distinct()
        for k in keys.values():
            seed_df = seed_df.filter(F.col(k).isNotNull())
        inner = {n: fresh("i") for n in shared}
        seed_df = seed_df.select(*[F.col(keys[n]).alias(inner[n]) for n in shared])
        seed = Rows(rows.context, seed_df, {n: Value(F.col(inner[n]), rows.vars[n].type, extra={"id": inner[n]}) for n in shared})
        right = Matcher(seed, patterns, where).run()
    else:
        inner, right = {}, Matcher(Rows.one(rows.context), patterns, where).run()
    # columns of the right side's copies of shared variables are not taken over
    both = rows.copy(left.df, {**right.vars, **left.vars})
    cond = [F.col(keys[n]).eqNullSafe(F.col(inner[n])) for n in shared]
    on = reduce(lambda a, b: a & b, cond) if cond else F.lit(True)
    for c in joint:
        on = on & Compiler(both).predicate(c)
    out = rows.copy(left.df.join(right.df, on, "left"), {**{k: v for k, v in right.vars.items() if k not in left.vars}, **left.vars})
    if both.df is not left.df:
        raise GraphError("InvalidArgument", "this condition of OPTIONAL MATCH needs a join of its own; bind its values before")
    order = [*left.vars, *[k for k in right.vars if k not in left.vars and k not in given]]
    out.vars = {k: out.vars[k] for k in order}
    return out


__all__ = ["STRING", "match"]
