"""WITH and RETURN: projection, aggregation, DISTINCT, ordering, SKIP and LIMIT; and UNWIND."""

from __future__ import annotations

import copy

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.errors import GraphError
from weft.functions import scalar
from weft.functions.values import BOOL, FLOAT, INT, NULL, NUMBERS, Type, Value, as_type, bad, ddl, guard, list_of, null_of, unify
from weft.lang import ast as A
from weft.lang import text as T
from weft.plans.expressions import Compiler, children, has_aggregate
from weft.plans.rows import Rows, fresh


def replaced(x: A.Node, swap) -> A.Node:
    """A copy of the tree in which swap(node) stands for a node where it isn't None."""
    new = swap(x)
    if new is not None:
        return new
    out = copy.copy(x)
    for k, v in vars(x).items():
        if isinstance(v, A.Node):
            setattr(out, k, replaced(v, swap))
        elif isinstance(v, list):
            setattr(out, k, [tuple(replaced(j, swap) if isinstance(j, A.Node) else j for j in i) if isinstance(i, tuple) else replaced(i, swap) if isinstance(i, A.Node) else i for i in v])
    return out


# --------------------------------------------------------------------------------------------------------- aggregates
def _finite(c: Column) -> Column:
    return guard(F.abs(c) == float("inf"), "the result is out of range", c, FLOAT)


def aggregate(call: A.Call, rows: Rows, order: Column | None) -> tuple[Column, Type]:
    """The aggregate's column for groupBy().agg(), over columns that are added to the rows."""
    low = call.name.lower()
    if call.star:
        return F.count(F.lit(1)), INT
    if len(call.args) != (2 if low == "percentiledisc" else 1):
        raise GraphError("Semantic", f"{call.name} takes {2 if low == 'percentiledisc' else 1} argument(s)", *call.pos)
    v = Compiler(rows)(call.args[0])
    name = rows.named(v.col if v.kind != "null" else F.lit(None).cast("bigint"), "x")
    x = F.col(name)
    if v.kind == "null":
        v = Value(x, INT)
    if low in ("sum", "avg", "stdev", "percentiledisc") and v.kind not in NUMBERS and not (low == "percentiledisc"):
        bad(f"{call.name} of a {v.kind}")
    if low == "count":
        return (F.count_distinct(x) if call.distinct else F.count(x)), INT
    if low == "sum":
        out = F.sum_distinct(x) if call.distinct else F.sum(x)
        return (out, INT) if v.kind == "int" else (_finite(out), FLOAT)
    if low == "avg":
        d = x.cast("double")
        total, n = (F.sum_distinct(d), F.count_distinct(d)) if call.distinct else (F.sum(d), F.count(d))
        return _finite(F.when(n > 0, total / n)), FLOAT
    if low in ("min", "max"):
        return (F.min(x) if low == "min" else F.max(x)), v.type
    if low == "stdev":
        if call.distinct:
            listed = F.array_sort(F.collect_set(x.cast("double")))
            mean = F.aggregate(listed, F.lit(0.0), lambda a, e: a + e) / F.size(listed)
            square = F.aggregate(listed, F.lit(0.0), lambda a, e: a + (e - mean) * (e - mean))
            return F.when(F.size(listed) > 1, F.sqrt(square / (F.size(listed) - 1))), FLOAT
        return F.stddev_samp(x.cast("double")), FLOAT
    if low == "collect":
        if order is None:
            listed = F.collect_list(x)
        else:
            listed = F.transform(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), x.alias("x"))))), lambda s: s["x"])
        return (F.array_distinct(listed) if call.distinct else listed), list_of(v.type)
    p = Compiler(rows)(call.args[1])
    if p.kind == "null":
        return null_of(v.type), v.type
    if p.kind != "float" or (p.known and not 0 <= p.const <= 1):
        bad("percentileDisc takes a float from 0 to 1")
    if p.known and v.kind in NUMBERS and not call.distinct:
        # counts of values, combined before the shuffle; they are held as floats, which tell all integers below 2**53 apart
        found = F.expr(f"percentile_disc({p.const!r}D) WITHIN GROUP (ORDER BY `{name}`)").cast(ddl(v.type))
        return (found if v.kind == "float" else guard(F.max(F.abs(x)) >= 1 << 53, "percentileDisc takes integers below 2**53", found, INT)), v.type
    share = F.first(F.col(rows.named(p.col, "p")))
    sorted_list = F.array_sort(F.collect_set(x) if call.distinct else F.collect_list(x))
    place = F.greatest(F.lit(1), F.ceil(share * F.size(sorted_list)).cast("int"))
    return F.when(F.size(sorted_list) > 0, F.get(sorted_list, place - 1)), v.type


def _entity_order(rows: Rows) -> Column | None:
    """Rows are told apart by the ids of what patterns bound, in the order of binding."""
    if rows.order:
        return F.struct(F.col(rows.order))
    ids = [v.col for v in rows.vars.values() if v.kind in ("node", "edge")]
    lists = [v.col for v in rows.vars.values() if v.kind == "list" and v.type.elem and v.type.elem.kind == "edge"]
    cols = [*ids, *lists]
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(cols)]) if cols else None


def _count(x: A.Node | None, rows: Rows, what: str) -> int | None:
    """SKIP and LIMIT are evaluated on the driver, without rows."""
    if x is None:
        return None
    v = Compiler(Rows(rows.context, rows.df, {}))(x)
    n = v.const if v.known else rows.context.spark.range(1).select(v.col.alias("n")).first()["n"]
    if v.kind != "int" or n is None or n < 0:
        bad(f"{what} takes an integer of at least 0")
    return n


def project(rows: Rows, c: A.Projection) -> tuple[Rows, list[str]]:
    """The rows after a WITH or RETURN, and its column names in order."""
    items = list(c.items)
    if c.star:
        if not rows.vars:
            raise GraphError("Semantic", f"{c.keyword} * has nothing to return", *c.pos)
        items = [A.Item(A.Var(n), None) for n in rows.vars]
    names = [T.column(i) for i in items]
    for n in names:
        if names.count(n) > 1:
            raise GraphError("Semantic", f"the column {n} occurs twice", *c.pos)
    before = rows
    grouped = any(has_aggregate(i.expr) for i in items)
    out = _aggregated(rows, items, names) if grouped else _plain(rows, items, names)
    hidden = [] if grouped or c.distinct else [k for k in before.vars if k not in out.vars]
    if not grouped and not c.distinct:
        for k in hidden:
            out.vars.setdefault(k, before.vars[k])
    if c.distinct:
        keep = {n: out.named(out.vars[n].col, "d") for n in names}
        out.df = out.df.select(*keep.values()).dropDuplicates()
        out.vars = {n: Value(F.col(k), out.vars[n].type) for n, k in keep.items()}
        out.order = None
    shown = lambda: {n: out.vars[n] for n in names}
    if c.where is not None:
        inner = out.copy(names=shown())
        cond = Compiler(inner).predicate(c.where)
        out = out.copy(inner.df.filter(cond), out.vars)
    out = _ordered(out, c, names, items)
    final = out.copy(names=shown())
    final.order = out.order
    return final, names


def _plain(rows: Rows, items: list[A.Item], names: list[str]) -> Rows:
    compiler, new = Compiler(rows), {}
    for i, n in zip(items, names, strict=True):
        v = compiler(i.expr)
        if v.kind in ("node", "edge") and (v.props is not None or v.extra):
            new[n] = v  # the same columns under another name
        elif isinstance(i.expr, A.Var):
            new[n] = v
        else:
            t = v.type
            new[n] = Value(F.col(rows.named(v.col if v.kind != "null" else F.lit(None).cast("string"), "v")), t, const=v.const, known=v.known)
    out = rows.copy(rows.df, new)
    return out


def _aggregated(rows: Rows, items: list[A.Item], names: list[str]) -> Rows:
    order = None
    if any(isinstance(y, A.Call) and y.name.lower() == "collect" for i in items for y in _calls(i.expr)):
        order = _entity_order(rows)
        if order is not None:
            order = F.col(rows.named(order, "o"))
    keys: dict[str, tuple[str, Value]] = {}
    compiler = Compiler(rows)
    for i, n in zip(items, names, strict=True):
        if not has_aggregate(i.expr):
            v = compiler(i.expr)
            col = rows.named(v.col if v.kind != "null" else F.lit(None).cast("string"), "g")
            keys[n] = (col, v)
    aggs: dict[str, tuple[str, Column, Type]] = {}

    def slot(x: A.Node):
        if isinstance(x, A.Call) and x.name.lower() in scalar.AGGREGATES:
            if any(has_aggregate(a) for a in x.args):
                raise GraphError("Semantic", "aggregates can't be nested", *x.pos)
            at = T.expr(x)
            if at not in aggs:
                col, t = aggregate(x, rows, order)
                aggs[at] = (fresh("a"), col, t)
            return A.Var("\0" + at)
        text = T.expr(x) if not isinstance(x, A.Lit) else None
        for i, n in zip(items, names, strict=True):
            if n in keys and text is not None and T.expr(i.expr) == text:
                return A.Var("\0key " + n)
        return None

    rewritten = {n: replaced(i.expr, slot) for i, n in zip(items, names, strict=True) if n not in keys}
    if keys:
        df = rows.df.groupBy(*[k for k, _ in keys.values()]).agg(*[c.alias(a) for a, c, _ in aggs.values()])
    else:
        df = rows.df.agg(*[c.alias(a) for a, c, _ in aggs.values()])
    inner = {"\0" + at: Value(F.col(a), t) for at, (a, _, t) in aggs.items()}
    grouped_keys = {n: Value(F.col(k), v.type) for n, (k, v) in keys.items()}
    out = Rows(rows.context, df, {**inner, **{"\0key " + n: v for n, v in grouped_keys.items()}})
    new = {}
    for n in names:
        if n in keys:
            new[n] = grouped_keys[n]
        else:
            try:
                v = Compiler(out)(rewritten[n])
            except GraphError as e:
                if e.code == "Semantic" and "is not defined" in e.message:
                    raise GraphError("Semantic", f"{e.message.split(' ')[0]} is neither grouped nor aggregated", e.line, e.col) from None
                raise
            new[n] = Value(F.col(out.named(v.col, "v")), v.type)
    out.vars = new
    return out


def _calls(x: A.Node):
    if isinstance(x, A.Call):
        yield x
    for c in children(x):
        yield from _calls(c)


def _ordered(out: Rows, c: A.Projection, names: list[str], items: list[A.Item]) -> Rows:
    skip, limit = _count(c.skip, out, "SKIP"), _count(c.limit, out, "LIMIT")
    if c.order:
        texts = {T.expr(i.expr): n for i, n in zip(items, names, strict=True)}
        keys = []
        for k in c.order:
            swap = lambda x: A.Var(texts[T.expr(x)]) if not isinstance(x, A.Lit) and T.expr(x) in texts and not (isinstance(x, A.Var) and x.name in names) else None
            v = Compiler(out)(replaced(k.expr, swap))
            col = F.col(out.named(v.col if v.kind != "null" else F.lit(None).cast("string"), "k"))
            nulls = k.nulls or ("LAST" if k.descending else "FIRST")
            keys.append({(False, "FIRST"): col.asc_nulls_first, (False, "LAST"): col.asc_nulls_last, (True, "FIRST"): col.desc_nulls_first, (True, "LAST"): col.desc_nulls_last}[k.descending, nulls]())
        if skip is not None or limit is not None:  # ties have an order too, or pages would overlap
            keys += [v.col.asc() for v in out.vars.values() if v.kind in ("node", "edge")]
        out.df = out.df.orderBy(*keys)
    if skip:
        out.df = out.df.offset(skip)
    if limit is not None:
        out.df = out.df.limit(limit)
    if c.order and c.keyword == "WITH":
        out.order = fresh("ord")
        out.df = out.df.withColumn(out.order, F.monotonically_increasing_id())
    return out


def unwind(rows: Rows, c: A.Unwind) -> Rows:
    """One row for each element; null and the empty list give none."""
    x = c.source
    if isinstance(x, A.Call) and x.name.lower() == "range" and rows.unit and 2 <= len(x.args) <= 3:
        bounds = [Compiler(rows)(a) for a in x.args]
        if all(v.known and v.kind == "int" for v in bounds):
            a, b, s = bounds[0].const, bounds[1].const, bounds[2].const if len(bounds) > 2 else 1
            if s == 0:
                bad("the step is zero")
            name = fresh("u")
            return Rows(rows.context, rows.context.spark.range(a, b + (1 if s > 0 else -1), s).select(F.col("id").alias(name)), {c.name: Value(F.col(name), INT)})
    v = Compiler(rows)(x)
    if v.kind == "null":
        return rows.copy(rows.df.filter(F.lit(False)), {**rows.vars, c.name: Value(F.lit(None).cast("string"), NULL)})
    if v.kind != "list":
        bad(f"UNWIND of a {v.kind}")
    at, name = fresh("at"), fresh("u")
    elem = v.type.elem or NULL
    df = rows.df.select("*", F.posexplode(v.col).alias(at, name))
    out = rows.copy(df, {**rows.vars, c.name: Value(F.col(name) if elem.kind != "null" else F.lit(None).cast("string"), elem)})
    if rows.unit:
        out.order = at
    return out


def union(left: tuple[Rows, list[str]], right: tuple[Rows, list[str]], every: bool) -> tuple[Rows, list[str]]:
    (a, names), (b, other) = left, right
    if names != other:
        raise GraphError("Semantic", "both sides of UNION have the same columns in the same order")
    cols, types = {}, {}
    for n in names:
        types[n] = unify(a.vars[n].type, b.vars[n].type, f"values of the column {n}")
        cols[n] = fresh("un")
    side = lambda r: r.df.select(*[as_type(r.vars[n], types[n]).alias(cols[n]) if types[n].kind != "null" else F.lit(None).cast("string").alias(cols[n]) for n in names])
    df = side(a).unionByName(side(b))
    if not every:
        df = df.dropDuplicates()
    return Rows(a.context, df, {n: Value(F.col(cols[n]), types[n]) for n in names}), names


__all__ = ["BOOL", "ddl", "project", "union", "unwind"]
