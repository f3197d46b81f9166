"""Expressions to columns. What needs the graph (properties of values, degrees, paths) becomes a join on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.errors import GraphError
from weft.functions import scalar, temporal
from weft.functions.values import ANY, BOOL, DATETIME, EDGE, FLOAT, INT, KEYS, MIXED, NODE, NULL, NUMBERS, STRING, Type, Value, as_type, bad, ddl, fail, guard, list_of, map_of, null_of, unify
from weft.lang import ast as A

_MAY_FAIL = (A.Call, A.Param)


def conjuncts(x: A.Node | None) -> list[A.Node]:
    if x is None:
        return []
    if isinstance(x, A.Binary) and x.op == "AND":
        return conjuncts(x.a) + conjuncts(x.b)
    return [x]


def children(x: A.Node) -> list[A.Node]:
    """Direct subexpressions, those under an own variable included."""
    out = []
    for v in vars(x).values():
        if isinstance(v, A.Node):
            out.append(v)
        elif isinstance(v, list):
            for i in v:
                out += [j for j in (i if isinstance(i, tuple) else (i,)) if isinstance(j, A.Node)]
    return out


def walk(x: A.Node):
    yield x
    for c in children(x):
        yield from walk(c)


def free(x: A.Node) -> set[str]:
    """Names that an expression takes from outside."""
    if isinstance(x, A.Var):
        return {x.name}
    if isinstance(x, (A.Comprehension, A.Quantifier)):
        inner = set().union(*[free(y) for y in (x.where, getattr(x, "body", None)) if y is not None])
        return free(x.source) | (inner - {x.var})
    if isinstance(x, A.Reduce):
        return free(x.init) | free(x.source) | (free(x.body) - {x.acc, x.var})
    return set().union(set(), *[free(c) for c in children(x)])


def has_aggregate(x: A.Node) -> bool:
    return any(isinstance(y, A.Call) and y.name.lower() in scalar.AGGREGATES for y in walk(x))


def may_fail(x: A.Node) -> bool:
    return any((isinstance(y, A.Binary) and y.op in ("/", "%", "^", "*", "+", "-")) or isinstance(y, _MAY_FAIL) for y in walk(x))


def bounded(name: str, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(hi, F.col(name)))


def _floats(a: Value, b: Value) -> tuple[Column, Column]:
    return a.col.cast("double"), b.col.cast("double")


def _exact_sign(i: Column, f: Column) -> Column:
    """-1, 0 or 1 as an integer is below, at or above a float, exactly; NaN is above all."""
    d = i.cast("double")
    inside = (f >= -9223372036854775808.0) & (f < 9223372036854775808.0)
    whole = F.when(inside, f).otherwise(0.0).cast("bigint")
    near = F.when(~inside, F.when(f > 0, -1).otherwise(1)).when(i < whole, -1).when(i > whole, 1).otherwise(0)
    return F.when(i.isNull() | f.isNull(), F.lit(None).cast("int")).when(d < f, -1).when(d > f, 1).otherwise(near)


def compare(op: str, a: Value, b: Value) -> Value:
    """Three-valued comparison: null if a side is null or the kinds can't be compared."""
    null = Value(null_of(BOOL), BOOL)
    if "null" in (a.kind, b.kind):
        return null
    if "any" in (a.kind, b.kind) and a.kind in MIXED and b.kind in MIXED and unify_or_none(a.type, b.type) == ANY:
        return _compare_mixed(op, as_type(a, ANY), as_type(b, ANY))
    if a.kind != b.kind and not (a.kind in NUMBERS and b.kind in NUMBERS):
        return null
    if a.kind == "bool" and op not in ("=", "<>"):
        return null
    if a.kind == "datetime":
        if isinstance(a.extra.get("native"), str) and "instant" in b.extra:
            return _compare_native(op, a.extra["native"], *b.extra["instant"])
        if isinstance(b.extra.get("native"), str) and "instant" in a.extra:
            return _compare_native({"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), b.extra["native"], *a.extra["instant"])
    x, y = a.col, b.col
    if a.kind != b.kind:
        small = lambda v: v.known and abs(v.const) < 1 << 53
        if small(a) or small(b):
            x, y = _floats(a, b)
        else:
            sign = _exact_sign(x, y) if a.kind == "int" else -_exact_sign(y, x)
            x, y = sign, F.lit(0)
    elif a.kind in ("list", "map", "path", "datetime", "duration") and a.type != b.type:
        try:
            t = unify(a.type, b.type)
        except GraphError:
            return Value(F.when(x.isNotNull() & y.isNotNull(), op == "<>"), BOOL) if op in ("=", "<>") else null
        x, y = as_type(a, t), as_type(b, t)
    ops = {"=": lambda: x == y, "<>": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}
    return Value(ops[op](), BOOL)


def unify_or_none(a: Type, b: Type) -> Type | None:
    try:
        return unify(a, b)
    except GraphError:
        return None


def _compare_native(op: str, name: str, nanos: int, off: int | None) -> Value:
    """A native timestamp, which has no offset, against a constant: a comparison that reaches the scan.

    At the same instant, one without an offset comes before one with an offset.
    """
    col, below, exact = F.col(name), nanos // 1000, nanos % 1000 == 0
    at = F.timestamp_micros(F.lit(below))
    if op in ("=", "<>"):
        if exact and off is None:
            return Value(col == at if op == "=" else col != at, BOOL)
        return Value(F.when(col.isNotNull(), op == "<>"), BOOL)
    # whether the instant itself lies below the constant
    tie_below = off is not None or not exact
    less = op in ("<", "<=")
    inclusive = (op == "<=" or tie_below) if less else (op == ">=" and not tie_below)
    out = (col <= at if inclusive else col < at) if less else (col >= at if inclusive else col > at)
    return Value(out, BOOL)


def _compare_mixed(op: str, x: Column, y: Column) -> Value:
    """Values of the same kind compare as ever; of others, and bools by size, the comparison is null."""
    a, b = (F.struct(c["num"], c["text"]) for c in (x, y))
    out = {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    same = x["rank"] == y["rank"]
    return Value(F.when(same if op in ("=", "<>") else same & ~x["rank"].isin(1, 8, 9), out), BOOL)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if "null" in (a.kind, b.kind):
        t = b.type if a.kind == "null" else a.type
        return Value(null_of(t), t)
    if op == "^":
        return scalar.power(a, b)
    if a.kind in NUMBERS and b.kind in NUMBERS:
        if op == "%":
            if a.kind != "int" or b.kind != "int":
                bad("% takes integers")
            return Value(guard(b.col == 0, "division by zero", F.when(b.col == -1, F.when(a.col.isNotNull(), F.lit(0).cast("bigint"))).otherwise(a.col % F.nullif(b.col, F.lit(0).cast("bigint"))), INT), INT)
        if a.kind == b.kind == "int":
            if op == "/":
                return Value(F.call_function("div", a.col, b.col), INT)
            return Value({"+": lambda: a.col + b.col, "-": lambda: a.col - b.col, "*": lambda: a.col * b.col}[op](), INT)
        x, y = _floats(a, b)
        if op == "/":
            return Value(guard(y == 0, "division by zero", x / F.nullif(y, F.lit(0.0)), FLOAT), FLOAT)
        return Value({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[op](), FLOAT)
    if op == "+" and a.kind == b.kind == "string":
        return Value(F.concat(a.col, b.col), STRING)
    if op == "+" and a.kind == b.kind == "list":
        t = unify(a.type, b.type)
        return Value(F.concat(as_type(a, t), as_type(b, t)), t)
    if op in "+-" and (found := temporal.add(a, b, 1 if op == "+" else -1)):
        return found
    if op == "*" and {a.kind, b.kind} == {"duration", "int"}:
        return temporal.scale(a, b) if a.kind == "duration" else temporal.scale(b, a)
    if op == "/" and (a.kind, b.kind) == ("duration", "int"):
        return temporal.divide(a, b)
    bad(f"{a.kind} {op} {b.kind}")


def boolean(v: Value, what: str) -> Column:
    if v.kind == "null":
        return null_of(BOOL)
    if v.kind == "any":
        return F.when(v.col.isNotNull(), guard(v.col["kind"] != "bool", f"{what} of mixed kinds", v.col["num"] == 1, BOOL))
    if v.kind != "bool":
        bad(f"{what} of a {v.kind}")
    return v.col


class Compiler:
    """Compiles expressions against rows (see plans.rows), whose DataFrame it may extend by joins."""

    def __init__(self, rows, local: dict[str, Value] | None = None):
        self.rows = rows
        self.local = local or {}

    def __call__(self, x: A.Node) -> Value:
        return getattr(self, "_" + type(x).__name__.lower())(x)

    def inner(self, **names: Value) -> Compiler:
        return Compiler(self.rows, {**self.local, **names})

    def predicate(self, x: A.Node) -> Column:
        return boolean(self(x), "a condition")

    # --------------------------------------------------------------------------------------------------------- leaves
    def _lit(self, x: A.Lit) -> Value:
        v = x.value
        if v is None:
            return Value(F.lit(None), NULL, const=None, known=True)
        if isinstance(v, bool):
            return Value(F.lit(v), BOOL, const=v, known=True)
        if isinstance(v, int):
            return Value(F.lit(v).cast("bigint"), INT, const=v, known=True)
        if isinstance(v, float):
            return Value(F.lit(v), FLOAT, const=v, known=True)
        return Value(F.lit(v), STRING, const=v, known=True)

    def _param(self, x: A.Param) -> Value:
        params = self.rows.context.params
        if x.name not in params:
            bad(f"the parameter {x.name} is missing")
        return constant(params[x.name])

    def _var(self, x: A.Var) -> Value:
        v = self.local.get(x.name) or self.rows.vars.get(x.name)
        if v is None:
            raise GraphError("Semantic", f"{x.name} is not defined", *x.pos)
        return v

    # ------------------------------------------------------------------------------------------------------ composites
    def _prop(self, x: A.Prop) -> Value:
        base = self(x.base)
        if base.kind == "null":
            return Value(F.lit(None), NULL)
        if base.kind == "map":
            found = dict(base.type.fields).get(x.key)
            return Value(base.col[x.key], found) if found else Value(F.lit(None), NULL)
        if base.kind in ("node", "edge"):
            return self.property(base, x.key)
        if base.kind == "any":  # of a map in a mixed column: scalars as text, as kinds differ from row to row
            json = F.get_json_object(base.col["text"], "$['" + x.key.replace("'", "\\'") + "']")
            return Value(F.when(base.col.isNotNull(), guard(base.col["kind"] != "map", f"property {x.key} of mixed kinds", json, STRING)), STRING)
        if base.kind == "list":
            raise GraphError("Semantic", "a list has no properties", *x.pos)
        bad(f"property {x.key} of a {base.kind}")

    def property(self, base: Value, key: str) -> Value:
        if base.props is not None and key in base.props:
            name, t = base.props[key]
            native = base.extra.get("native", {}).get(key)
            return Value(F.col(name), t, extra={"native": native} if native else {})
        if base.props is not None and base.extra.get("whole"):
            return Value(F.lit(None), NULL)
        lists = base.extra.get("lists")
        if lists is not None:
            return self.rows.element_property(base, lists, key)
        return self.rows.lookup(base, key)

    def _index(self, x: A.Index) -> Value:
        base, at = self(x.base), self(x.at)
        if base.kind == "null" or at.kind == "null":
            return Value(F.lit(None), NULL)
        if base.kind == "list":
            if at.kind != "int":
                bad("a list is indexed by integers")
            n = at.col.cast("int")
            picked = F.when(n >= 0, F.get(base.col, n)).when(n < 0, F.try_element_at(base.col, F.when(n < 0, n).otherwise(-1)))
            return Value(picked, base.type.elem or NULL)
        if base.kind in ("map", "node", "edge") and at.kind == "string":
            if at.known:
                return self._prop(A.Prop(x.base, at.const, pos=x.pos))
            fields = {k: t for k, t in base.type.fields if k != KEYS} if base.kind == "map" else {k: t for k, (_, t) in (base.props or {}).items()}
            t = NULL
            for f in fields.values():
                t = unify(t, f)
            out = null_of(t)
            for k in fields:
                v = Value(base.col[k], fields[k]) if base.kind == "map" else Value(F.col(base.props[k][0]), fields[k])
                out = F.when(at.col == k, as_type(v, t)).otherwise(out)
            return Value(out, t)
        bad(f"{base.kind} indexed by {at.kind}")

    def _slice(self, x: A.Slice) -> Value:
        base, lo = self(x.base), self(x.lo)
        hi = self(x.hi) if x.hi is not None else None
        if base.kind == "null" or lo.kind == "null" or (hi and hi.kind == "null"):
            return Value(F.lit(None), NULL)
        if base.kind != "list" or lo.kind != "int" or (hi and hi.kind != "int"):
            bad("a slice is taken of a list, by integers")
        n = F.size(base.col)
        place = lambda v: F.least(n, F.greatest(F.lit(0), F.when(v < 0, v + n).otherwise(v).cast("int")))
        a, b = place(lo.col), place(hi.col) if hi else n
        return Value(F.when(base.col.isNotNull(), F.slice(base.col, a + 1, F.greatest(F.lit(0), b - a))), base.type)

    def _listlit(self, x: A.ListLit) -> Value:
        items, t = [self(i) for i in x.items], NULL
        for v in items:
            t = unify(t, v.type, "list items")
        known = all(v.known for v in items)
        return Value(F.array(*[as_type(v, t) for v in items]).cast(ddl(list_of(t))) if not items else F.array(*[as_type(v, t) for v in items]), list_of(t), const=[v.const for v in items] if known else None, known=known)

    def _maplit(self, x: A.MapLit) -> Value:
        vs = {k: self(v) for k, v in x.entries}
        t = map_of({k: v.type for k, v in vs.items()})
        return Value(F.struct(*[vs[k].col.alias(k) for k, _ in t.fields]) if vs else F.struct(), t)

    # ------------------------------------------------------------------------------------------------------- operators
    def _unary(self, x: A.Unary) -> Value:
        v = self(x.x)
        if x.op == "NOT":
            return Value(~boolean(v, "NOT"), BOOL)
        if v.kind == "null":
            return v
        if v.kind not in NUMBERS:
            bad(f"{x.op} of a {v.kind}")
        if x.op == "+":
            return v
        if v.known:
            return constant(-v.const)
        return Value(-v.col, v.type)

    def _binary(self, x: A.Binary) -> Value:
        op = x.op
        if op in ("AND", "OR", "XOR"):
            a, b = boolean(self(x.a), op), boolean(self(x.b), op)
            if op == "XOR":
                return Value(a != b, BOOL)
            if may_fail(x.b):  # the left side decides first, and keeps the right side from failing
                decided = a == F.lit(op == "OR")
                return Value(F.when(decided, op == "OR").otherwise((a & b) if op == "AND" else (a | b)), BOOL)
            return Value(a & b if op == "AND" else a | b, BOOL)
        a, b = self(x.a), self(x.b)
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return compare(op, a, b)
        if op == "IN":
            return self.member(a, b)
        if op in ("STARTS WITH", "ENDS WITH", "CONTAINS"):
            if "null" in (a.kind, b.kind):
                return Value(null_of(BOOL), BOOL)
            if a.kind != "string" or b.kind != "string":
                bad(f"{a.kind} {op} {b.kind}")
            return Value({"S": a.col.startswith, "E": a.col.endswith, "C": a.col.contains}[op[0]](b.col), BOOL)
        return arithmetic(op, a, b)

    def member(self, a: Value, b: Value) -> Value:
        if b.kind == "null":
            return Value(null_of(BOOL), BOOL)
        if b.kind != "list":
            bad(f"IN a {b.kind}")
        elem = b.type.elem or NULL
        if b.known and a.kind == elem.kind and None not in b.const and b.const and a.kind in ("int", "string"):
            return Value(a.col.isin(b.const), BOOL)  # a form that reaches the scan
        return Value(F.exists(b.col, lambda e: compare("=", Value(e, elem), a).col), BOOL)

    def _isnull(self, x: A.IsNull) -> Value:
        v = self(x.x)
        return Value(v.col.isNotNull() if x.negated else v.col.isNull(), BOOL)

    def _istype(self, x: A.IsType) -> Value:
        v = self(x.x)
        same = v.col.isNull() if x.type == "NULL" else F.coalesce(v.col["kind"] == x.type.lower(), F.lit(False)) if v.kind == "any" else v.col.isNotNull() & F.lit(v.kind == x.type.lower())
        return Value(~same if x.negated else same, BOOL)

    # ----------------------------------------------------------------------------------------------------------- lists
    def source(self, x: A.Node, what: str) -> Value:
        v = self(x)
        if v.kind not in ("list", "null"):
            bad(f"{what} of a {v.kind}")
        return v

    def element(self, source: Value, e: Column) -> Value:
        t = source.type.elem or NULL
        return Value(e, t, extra={"lists": source.col} if t.kind in ("node", "edge") else {})

    def _prepare(self, source: Value, var: str, *bodies: A.Node | None) -> None:
        """Joins that lambda bodies need are made before the lambda is built."""
        elem = source.type.elem or NULL
        for body in bodies:
            if body is None:
                continue
            for y in walk(body):
                if isinstance(y, A.Prop) and isinstance(y.base, A.Var) and y.base.name == var and elem.kind in ("node", "edge"):
                    self.rows.element_property(Value(F.lit(None).cast("bigint"), elem), source.col, y.key)

    def _comprehension(self, x: A.Comprehension) -> Value:
        source = self.source(x.source, "a comprehension")
        if source.kind == "null":
            return source
        self._prepare(source, x.var, x.where, x.body)
        out, t = source.col, source.type
        if x.where is not None:
            out = F.filter(out, lambda e: F.coalesce(self.inner(**{x.var: self.element(source, e)}).predicate(x.where), F.lit(False)))
        if x.body is not None:
            found: list[Type] = []

            def body(e):
                v = self.inner(**{x.var: self.element(source, e)})(x.body)
                found.append(v.type)
                return v.col

            out = F.transform(out, body)
            t = list_of(found[0])
        return Value(out, t)

    def _quantifier(self, x: A.Quantifier) -> Value:
        source = self.source(x.source, x.kind)
        if source.kind == "null":
            return Value(null_of(BOOL), BOOL)
        self._prepare(source, x.var, x.where)
        n = F.size(F.filter(source.col, lambda e: F.coalesce(self.inner(**{x.var: self.element(source, e)}).predicate(x.where), F.lit(False))))
        out = {"ANY": n > 0, "ALL": n == F.size(source.col), "NONE": n == 0, "SINGLE": n == 1}[x.kind]
        return Value(F.when(source.col.isNotNull(), out), BOOL)

    def _reduce(self, x: A.Reduce) -> Value:
        source, init = self.source(x.source, "REDUCE"), self(x.init)
        if source.kind == "null":
            return source
        self._prepare(source, x.var, x.body)
        t = init.type
        for _ in range(4):  # the accumulator's type is the one that the body keeps
            probe = self.inner(**{x.acc: Value(null_of(t) if t.kind != "null" else F.lit(None), t), x.var: Value(null_of(source.type.elem or NULL), source.type.elem or NULL)})(x.body).type
            wider = unify(t, probe)
            if wider == t:
                break
            t = wider
        merge = lambda a, e: as_type(self.inner(**{x.acc: Value(a, t), x.var: self.element(source, e)})(x.body), t)
        return Value(F.aggregate(source.col, as_type(init, t), merge), t)

    def _case(self, x: A.Case) -> Value:
        base = self(x.base) if x.base is not None else None
        arms, t = [], NULL
        for when, then in x.whens:
            cond = compare("=", base, self(when)).col if base is not None else self.predicate(when)
            v = self(then)
            t = unify(t, v.type, "CASE results")
            arms.append((cond, v))
        other = self(x.otherwise) if x.otherwise is not None else Value(F.lit(None), NULL)
        t = unify(t, other.type, "CASE results")
        out = None
        for cond, v in arms:
            out = F.when(cond, as_type(v, t)) if out is None else out.when(cond, as_type(v, t))
        return Value(out.otherwise(as_type(other, t)), t)

    # -------------------------------------------------------------------------------------------------------- calls
    def _call(self, x: A.Call) -> Value:
        low = x.name.lower()
        if low in scalar.AGGREGATES:
            raise GraphError("Semantic", f"{x.name} is not allowed here", *x.pos)
        if x.distinct:
            raise GraphError("Semantic", "DISTINCT belongs to aggregates", *x.pos)
        if low not in scalar.ARITY:
            bad(f"there is no function {x.name}")
        least, most = scalar.ARITY[low]
        if len(x.args) < least or (most is not None and len(x.args) > most):
            raise GraphError("Semantic", f"{x.name} takes {least}{'' if most == least else f' to {most}' if most else ' or more'} arguments", *x.pos)
        if low == "now":
            return constant_now(self.rows.context.now)
        if low == "rand" and self.rows.context.seed is not None:
            self.rows.context.seed += 1  # each call has numbers of its own
            return Value(F.rand(self.rows.context.seed), FLOAT)
        args = [self(a) for a in x.args]
        if low in scalar.GRAPH:
            return self.graph_call(low, x.name, args)
        if low == "keys" and args[0].kind in ("node", "edge"):
            return self.rows.entity_keys(args[0])
        return scalar.call(x.name, args)

    def graph_call(self, low: str, name: str, args: list[Value]) -> Value:
        v = args[0]
        if any(a.kind == "null" for a in args):
            return Value(F.lit(None), NULL)
        want = {"labels": ("node",), "type": ("edge",), "startnode": ("edge",), "endnode": ("edge",), "id": ("node", "edge"), "properties": ("node", "edge", "map"), "degree": ("node",), "neighbors": ("node",), "shortestpath": ("node",), "allshortestpaths": ("node",)}.get(low, ("path",))
        if v.kind not in want:
            bad(f"{name} of a {v.kind}")
        if low == "id":
            return Value(v.col, INT)
        if low == "length":
            return Value(F.when(v.col.isNotNull(), F.size(v.col["edges"])).cast("bigint"), INT)
        if low == "nodes":
            return Value(v.col["nodes"], list_of(NODE))
        if low == "relationships":
            return Value(v.col["edges"], list_of(EDGE))
        if low == "properties" and v.kind == "map":
            return v
        if low in ("labels", "type", "startnode", "endnode"):
            field, t = {"labels": ("labels", list_of(STRING)), "type": ("type", STRING), "startnode": ("src", NODE), "endnode": ("dst", NODE)}[low]
            return Value(F.col(v.extra[field]), t) if field in v.extra else Value(self.rows.entity_field(v, field), t)
        if low == "properties":
            return self.rows.entity_properties(v)
        return self.rows.traversal(low, args)


def constant(v: object) -> Value:
    """A Python value as a constant."""
    import datetime as dt

    if isinstance(v, dt.datetime):
        return Value(temporal.datetime_lit(*temporal.parse_datetime(v.isoformat())), DATETIME)
    if isinstance(v, dt.date):
        return temporal.to_date(Value(F.lit(v.isoformat()), STRING, const=v.isoformat(), known=True))
    if isinstance(v, bytes):
        return Value(F.lit(v), Type("bytes"), const=v, known=True)
    if isinstance(v, (list, tuple)):
        items, t = [constant(x) for x in v], NULL
        for x in items:
            t = unify(t, x.type, "list items")
        known = all(x.known for x in items)
        return Value(F.array(*[as_type(x, t) for x in items]) if items else F.array().cast(ddl(list_of(t))), list_of(t), const=[x.const for x in items] if known else None, known=known)
    if isinstance(v, dict):
        vs = {k: constant(x) for k, x in v.items()}
        t = map_of({k: x.type for k, x in vs.items()})
        return Value(F.struct(*[vs[k].col.alias(k) for k, _ in t.fields]), t)
    if v is None or isinstance(v, (bool, int, float, str)):
        if isinstance(v, int) and not isinstance(v, bool) and not -(1 << 63) <= v < 1 << 63:
            bad("the number is out of range")
        return Compiler(None)._lit(A.Lit(v))
    bad(f"values of type {type(v).__name__} aren't supported")


def constant_now(now) -> Value:
    if now is not None:
        return Value(temporal.datetime_lit(*temporal.parse_datetime(now)), DATETIME)
    return Value(F.struct((F.unix_micros(F.current_timestamp()) * 1000).alias("nanos"), F.lit(0).alias("off")), DATETIME)


__all__ = ["Compiler", "arithmetic", "boolean", "compare", "conjuncts", "constant", "free", "has_aggregate", "walk", "fail"]
