"""Scalar functions by name: argument values to a value. Nulls give null except where a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.errors import GraphError
from weft.functions import temporal
from weft.functions.values import BOOL, BYTES, FLOAT, INT, KEYS, NULL, NUMBERS, STRING, Type, Value, as_type, bad, ddl, fail, guard, keys_of, list_of, null_of, own_keys, unify
from weft.lang import text as T

RANGE_LIMIT = 1 << 20
AGGREGATES = frozenset({"count", "sum", "avg", "min", "max", "collect", "percentiledisc", "stdev"})
GRAPH = {"id": (1, 1), "labels": (1, 1), "type": (1, 1), "startnode": (1, 1), "endnode": (1, 1), "properties": (1, 1), "degree": (1, 2), "neighbors": (2, 2), "shortestpath": (2, 2), "allshortestpaths": (2, 2), "length": (1, 1), "nodes": (1, 1), "relationships": (1, 1)}


def _need(v: Value, kinds: tuple[str, ...], name: str) -> None:
    if v.kind not in kinds:
        bad(f"{name} of a {v.kind}")


# ------------------------------------------------------------------------------------------------------------ as text
def go_quoted(c: Column) -> Column:
    """A string in double quotes with the usual escapes."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, named in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(named))
    return F.concat(F.lit('"'), out, F.lit('"'))


def float_text(c: Column) -> Column:
    """Shortest text that reads back the same: plain between 1e-4 and 1e21, with an exponent outside."""
    raw = c.cast("string")
    digits = F.regexp_replace(F.regexp_extract(raw, r"^-?([0-9.]+)", 1), r"\.0$", "")
    exponent = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(raw, r"E(-?\d+)$", 1), F.lit("")), F.lit("S999")).cast("int"), F.lit(0))
    figures, whole = F.replace(digits, F.lit(".")), exponent + 1
    exact = F.when(F.length(figures) <= whole, F.concat(F.rpad(figures, whole, F.lit("0")), F.lit(".0"))).otherwise(F.concat(F.substring(figures, F.lit(1), whole), F.lit("."), F.substring(figures, whole + 1, F.length(figures))))
    power = F.concat(digits, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    body = F.when(exponent == 0, F.regexp_extract(raw, r"^-?(.*)$", 1)).when((F.abs(c) >= 1e-4) & (F.abs(c) < 1e21), F.when(F.abs(c) >= 1, exact).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), F.replace(digits, F.lit(".")))))
    body = body.otherwise(power)
    return F.when(F.isnan(c), "NaN").when(c == float("inf"), "Inf").when(c == float("-inf"), "-Inf").otherwise(F.concat(F.when(raw.startswith("-"), "-").otherwise(""), body))


def as_text(v: Value) -> Column:
    k = v.kind
    if k == "string":
        return go_quoted(v.col)
    if k == "float":
        return float_text(v.col)
    if k in ("int", "bool"):
        return v.col.cast("string")
    if k == "bytes":
        return F.concat(F.lit('bytes("'), F.base64(v.col), F.lit('")'))
    if k == "date":
        return F.concat(F.lit('date("'), temporal.date_text(v.col), F.lit('")'))
    if k == "datetime":
        return F.concat(F.lit('datetime("'), temporal.datetime_text(v.col), F.lit('")'))
    if k == "duration":
        unit = lambda c, u: F.when(c != 0, F.concat(c.cast("string"), F.lit(u))).otherwise("")
        seconds = F.concat((v.col["nanos"] / 1e9).cast("decimal(28,9)").cast("string"), F.lit("S"))
        clock = F.when(v.col["nanos"] != 0, F.concat(F.lit("T"), F.regexp_replace(seconds, r"\.?0+S$", "S"))).otherwise("")
        body = F.concat(unit(v.col["months"], "M"), unit(v.col["days"], "D"), clock)
        return F.concat(F.lit('duration("P'), F.when(body == "", "T0S").otherwise(body), F.lit('")'))
    if k == "list":
        each = F.transform(v.col, lambda e: F.coalesce(as_text(Value(e, v.type.elem or NULL)), F.lit("null")))
        return F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]"))
    if k == "map":
        entry = lambda n, t: F.when(v.col[n].isNotNull(), F.concat(F.lit(T.key(n) + ": "), as_text(Value(v.col[n], t)))).otherwise(F.lit(T.key(n) + ": null"))
        loose = KEYS in dict(v.type.fields)
        parts = [F.when(F.array_contains(v.col[KEYS], n), entry(n, t)) if loose else entry(n, t) for n, t in v.type.fields if n != KEYS]
        return F.when(v.col.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))
    if k == "any":
        c = v.col
        date = as_text(Value(F.date_from_unix_date(c["num"].cast("int")), temporal.DATE))
        return F.when(c["kind"] == "string", go_quoted(c["text"])).when(c["kind"] == "int", c["num"].cast("bigint").cast("string")).when(c["kind"] == "float", float_text(c["num"])).when(c["kind"] == "bool", (c["num"] == 1).cast("string")).when(c["kind"] == "date", date).otherwise(c["text"])
    if k in ("node", "edge"):
        return F.concat(F.lit("(" if k == "node" else "["), v.col.cast("string"), F.lit(")" if k == "node" else "]"))
    return F.lit(None).cast("string")


# ---------------------------------------------------------------------------------------------------------- functions
def _upper(v):
    _need(v, ("string",), "toUpper")
    return Value(F.upper(v.col), STRING)


def _lower(v):
    _need(v, ("string",), "toLower")
    return Value(F.lower(v.col), STRING)


def _trim(v):
    _need(v, ("string",), "trim")
    return Value(F.regexp_replace(v.col, r"(?U)^\s+|\s+$", ""), STRING)


def _size(v):
    sizes = {"string": F.char_length, "bytes": F.octet_length, "list": F.size}
    if v.kind == "map":
        return Value(F.when(v.col.isNotNull(), F.size(own_keys(v))).cast("bigint"), INT)
    _need(v, tuple(sizes), "size")
    return Value(F.when(v.col.isNotNull(), sizes[v.kind](v.col)).cast("bigint"), INT)


def _split(s, sep):
    _need(s, ("string",), "split")
    _need(sep, ("string",), "split")
    parts = F.split(s.col, F.concat(F.lit("\\Q"), sep.col, F.lit("\\E")), F.lit(-1))
    return Value(guard(sep.col == "", "the separator is empty", parts, list_of(STRING)), list_of(STRING))


def _substring(s, start, length=None):
    _need(s, ("string",), "substring")
    n = length.col if length else F.lit(1 << 30).cast("bigint")
    cut = F.substring(s.col, F.least(start.col, F.lit(1 << 30)).cast("int") + 1, F.least(n, F.lit(1 << 30)).cast("int"))
    return Value(guard((start.col < 0) | (n < 0), "substring takes no negative numbers", F.when(start.col.isNotNull() & n.isNotNull(), cut), STRING), STRING)


def _replace(s, a, b):
    for v in (s, a, b):
        _need(v, ("string",), "replace")
    return Value(guard(a.col == "", "the text to replace is empty", F.replace(s.col, a.col, b.col), STRING), STRING)


def _pair(name, build):
    def of(s, t):
        _need(s, ("string",), name)
        _need(t, ("string",), name)
        return Value(build(s.col, t.col), BOOL)

    return of


def _abs(v):
    _need(v, NUMBERS, "abs")
    return Value(F.abs(v.col), v.type)


def _rounding(name):
    def of(v):
        _need(v, NUMBERS, name)
        if v.kind == "int":
            return v
        whole = {"ceil": F.ceil, "floor": F.floor}.get(name)
        small = whole(v.col).cast("double") if whole else F.round(v.col)
        return Value(F.when(F.isnan(v.col) | (F.abs(v.col) >= float(1 << 52)), v.col).otherwise(small), FLOAT)

    return of


def _sqrt(v):
    _need(v, NUMBERS, "sqrt")
    return Value(guard(v.col < 0, "sqrt of a negative number", F.sqrt(v.col), FLOAT), FLOAT)


def power(a: Value, b: Value) -> Value:
    _need(a, NUMBERS, "^")
    _need(b, NUMBERS, "^")
    x, y = a.col.cast("double"), b.col.cast("double")
    out = F.pow(x, y)
    undefined = ((x == 0) & (y < 0)) | (F.isnan(out) & ~F.isnan(x) & ~F.isnan(y))
    return Value(guard(undefined, "the power is undefined", out, FLOAT), FLOAT)


def _sign(v):
    _need(v, NUMBERS, "sign")
    s = F.signum(v.col.cast("double"))
    return Value(F.when(~F.isnan(s), s.cast("bigint")) if v.kind == "float" else s.cast("bigint"), INT)


def _range(a, b, step=None):
    for v in (a, b, *([step] if step else [])):
        _need(v, ("int",), "range")
    s = step.col if step else F.lit(1).cast("bigint")
    t = list_of(INT)
    empty = ((s > 0) & (a.col > b.col)) | ((s < 0) & (a.col < b.col))
    steps = F.floor((b.col.cast("double") - a.col.cast("double")) / F.nullif(s, F.lit(0)).cast("double"))
    body = F.when(empty, F.array().cast(ddl(t))).when(a.col == b.col, F.array(a.col)).when(steps >= RANGE_LIMIT, fail("the range is too long", "ResourceExhausted").cast(ddl(t))).otherwise(F.sequence(a.col, b.col, s))
    return Value(F.when(a.col.isNotNull() & b.col.isNotNull() & s.isNotNull(), guard(s == 0, "the step is zero", body, t)), t)


def _list_fn(name, build, elem=False):
    def of(v):
        _need(v, ("list",), name)
        return Value(build(v.col), (v.type.elem or NULL) if elem else v.type)

    return of


def _keys(v):
    if v.kind == "map":
        return Value(own_keys(v), list_of(STRING))
    if v.kind in ("node", "edge"):
        named = [F.when(F.col(c).isNotNull(), F.lit(k)) for k, (c, _) in sorted((v.props or {}).items())]
        return Value(F.when(v.col.isNotNull(), F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")), list_of(STRING))
    bad(f"keys of a {v.kind}")


def _values(v):
    _need(v, ("map",), "values")
    t = NULL
    fields = dict(v.type.fields)
    for k in keys_of(v.type):
        t = unify(t, fields[k])
    held = [as_type(Value(v.col[k], fields[k]), t) for k in keys_of(v.type)]
    every = F.array(*held) if held else F.array().cast(ddl(list_of(t)))
    if KEYS in fields:
        # places of the keys that the map has, in the order of all
        places = F.transform(v.col[KEYS], lambda k: F.array_position(F.array(*[F.lit(x) for x in keys_of(v.type)]), k).cast("int"))
        every = F.transform(places, lambda i: F.get(every, i - 1))
    return Value(F.when(v.col.isNotNull(), every), list_of(t))


def _to_int(v):
    if v.kind == "int":
        return v
    if v.kind == "float":
        return Value(guard(F.isnan(v.col) | (F.abs(v.col) >= 9.223372036854775807e18), "the number is out of range", v.col.cast("bigint"), INT), INT)
    _need(v, ("string",), "toInt")
    return Value(guard(~v.col.rlike(r"^[+-]?[0-9]+$"), "the text is not an integer", v.col.cast("bigint"), INT), INT)


def _to_float(v):
    if v.kind in NUMBERS:
        return Value(v.col.cast("double"), FLOAT)
    _need(v, ("string",), "toFloat")
    pattern = r"(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(inf|infinity)$|^nan$"
    return Value(guard(~v.col.rlike(pattern), "the text is not a number", v.col.cast("double"), FLOAT), FLOAT)


def _to_bool(v):
    if v.kind == "bool":
        return v
    _need(v, ("string",), "toBool")
    low = F.lower(v.col)
    return Value(F.when(low == "true", True).when(low == "false", False).when(low.isNotNull(), fail("the text is neither true nor false").cast("boolean")), BOOL)


def _bytes(v):
    if v.kind == "bytes":
        return v
    _need(v, ("string",), "bytes")
    pattern = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
    return Value(guard(~v.col.rlike(pattern), "the text is not base64", F.unbase64(v.col), BYTES), BYTES)


def coalesce(*vs):
    t = NULL
    for v in vs:
        t = unify(t, v.type)
    return Value(F.coalesce(*[as_type(v, t) for v in vs]), t)


def type_of(v):
    if v.kind == "any":
        return Value(F.coalesce(v.col["kind"], F.lit("null")), STRING)
    return Value(F.lit("null") if v.kind == "null" else F.when(v.col.isNull(), "null").otherwise(v.kind), STRING)


def to_string(v):
    return Value(as_text(v), STRING)


def _tail(c):
    return F.slice(c, F.lit(2), F.greatest(F.lit(0), F.size(c) - 1))


def _numeric(name):
    return lambda v: temporal.part(name, v)


#: name in lower case -> (least arguments, most or None, builder)
FUNCTIONS: dict[str, tuple[int, int | None, object]] = {
    "toupper": (1, 1, _upper),
    "tolower": (1, 1, _lower),
    "trim": (1, 1, _trim),
    "tostring": (1, 1, to_string),
    "size": (1, 1, _size),
    "split": (2, 2, _split),
    "substring": (2, 3, _substring),
    "replace": (3, 3, _replace),
    "startswith": (2, 2, _pair("startsWith", lambda a, b: a.startswith(b))),
    "endswith": (2, 2, _pair("endsWith", lambda a, b: a.endswith(b))),
    "contains": (2, 2, _pair("contains", lambda a, b: a.contains(b))),
    "abs": (1, 1, _abs),
    "ceil": (1, 1, _rounding("ceil")),
    "floor": (1, 1, _rounding("floor")),
    "round": (1, 1, _rounding("round")),
    "sqrt": (1, 1, _sqrt),
    "pow": (2, 2, power),
    "sign": (1, 1, _sign),
    "rand": (0, 0, lambda: Value(F.rand(), FLOAT)),
    "range": (2, 3, _range),
    "head": (1, 1, _list_fn("head", lambda c: F.get(c, F.lit(0)), True)),
    "last": (1, 1, _list_fn("last", lambda c: F.try_element_at(c, F.lit(-1)), True)),
    "tail": (1, 1, _list_fn("tail", _tail)),
    "reverse": (1, 1, _list_fn("reverse", F.reverse)),
    "keys": (1, 1, _keys),
    "values": (1, 1, _values),
    "toint": (1, 1, _to_int),
    "tofloat": (1, 1, _to_float),
    "tobool": (1, 1, _to_bool),
    "bytes": (1, 1, _bytes),
    "coalesce": (1, None, coalesce),
    "typeof": (1, 1, type_of),
    "date": (1, 1, temporal.to_date),
    "datetime": (1, 1, temporal.to_datetime),
    "duration": (1, 1, temporal.to_duration),
    "now": (0, 0, None),
    **{n: (1, 1, _numeric(n)) for n in temporal.PARTS},
}
ARITY = {**{n: (a, b) for n, (a, b, _) in FUNCTIONS.items()}, **GRAPH, **{n: (1, 1) for n in AGGREGATES}, "percentiledisc": (2, 2)}
_RESULTS = {"size": INT, "split": list_of(STRING), "abs": INT, "range": list_of(INT), "toint": INT, "tofloat": FLOAT, "tobool": BOOL, "toupper": STRING, "tolower": STRING, "trim": STRING}


def call(name: str, args: list[Value]) -> Value:
    low = name.lower()
    if low not in FUNCTIONS:
        raise GraphError("InvalidArgument", f"there is no function {name}")
    least, most, build = FUNCTIONS[low]
    if len(args) < least or (most is not None and len(args) > most):
        raise GraphError("Semantic", f"{name} takes {least}{'' if most == least else f' to {most}' if most else ' or more'} arguments")
    if any(v.kind == "null" for v in args) and low not in ("coalesce", "typeof"):
        t: Type = _RESULTS.get(low, NULL)
        return Value(null_of(t), t)
    return build(*args)
