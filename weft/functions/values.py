"""Static types of expressions, and how values of each kind are held in Spark columns.

kind      column
null      void
bool int float string bytes date    BOOLEAN BIGINT DOUBLE STRING BINARY DATE
datetime  STRUCT<nanos: BIGINT, off: INT>: UTC nanoseconds, and the offset in seconds where one was given
duration  STRUCT<months: BIGINT, days: BIGINT, nanos: BIGINT>
list      ARRAY
map       STRUCT with the keys as fields; where maps of unlike keys meet in one column also KEYS, those that a map has
node edge BIGINT, the id
path      STRUCT<nodes: ARRAY<BIGINT>, edges: ARRAY<BIGINT>>
any       STRUCT<rank: INT, num: DOUBLE, text: STRING, kind: STRING>: bools, numbers, strings, dates, lists and maps in
          one column; ordered by kind, then by value. Integers above 2**53 are rounded here, lists and maps are JSON text
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.errors import RAISED, GraphError


@dataclass(frozen=True)
class Type:
    kind: str
    elem: Type | None = None
    fields: tuple[tuple[str, Type], ...] = ()

    def __str__(self) -> str:
        return f"list of {self.elem}" if self.kind == "list" and self.elem else self.kind


NULL, BOOL, INT, FLOAT, STRING, BYTES, DATE, DATETIME, DURATION, NODE, EDGE, PATH, ANY = (Type(k) for k in "null bool int float string bytes date datetime duration node edge path any".split())
#: Kinds that a mixed column holds, and their order.
MIXED = {"bool": 1, "int": 2, "float": 2, "string": 3, "date": 5, "list": 8, "map": 9, "any": 0}
_JSON = ("null", "bool", "int", "float", "string")
#: Field of a map column that holds maps of unlike keys: the keys that the map has.
KEYS = "_weft_keys"
NUMBERS = ("int", "float")
_SPARK = {"null": "void", "bool": "boolean", "int": "bigint", "float": "double", "string": "string", "bytes": "binary", "date": "date", "datetime": "struct<nanos:bigint,off:int>", "duration": "struct<months:bigint,days:bigint,nanos:bigint>", "node": "bigint", "edge": "bigint", "path": "struct<nodes:array<bigint>,edges:array<bigint>>", "any": "struct<rank:int,num:double,text:string,kind:string>"}


def list_of(elem: Type) -> Type:
    return Type("list", elem)


def map_of(fields: dict[str, Type]) -> Type:
    return Type("map", None, tuple(sorted(fields.items())))


def ddl(t: Type) -> str:
    if t.kind == "list":
        return f"array<{ddl(t.elem or NULL)}>"
    if t.kind == "map":
        return "struct<" + ",".join(f"`{k}`:{ddl(v)}" for k, v in t.fields) + ">"
    return _SPARK[t.kind]


def keys_of(t: Type) -> list[str]:
    """All keys that maps of this type may have."""
    return [k for k, _ in t.fields if k != KEYS]


def _in_json(t: Type) -> bool:
    return t.kind in _JSON or (t.kind == "list" and _in_json(t.elem or NULL)) or (t.kind == "map" and all(_in_json(x) for k, x in t.fields if k != KEYS))


def own_keys(v: Value) -> Column:
    """The keys that a map has, in order."""
    if KEYS in dict(v.type.fields):
        return v.col[KEYS]
    return F.when(v.col.isNotNull(), F.array(*[F.lit(k) for k in keys_of(v.type)]).cast("array<string>"))


@dataclass
class Value:
    """A compiled expression. props, for a node or edge that a pattern bound: property -> column name."""

    col: Column
    type: Type
    props: dict[str, tuple[str, Type]] | None = None
    const: object = None  # the value of a literal
    known: bool = False  # whether const holds it
    extra: dict = field(default_factory=dict)  # columns of a bound entity: labels, type, src, dst

    @property
    def kind(self) -> str:
        return self.type.kind


def bad(message: str, pos: tuple[int, int] = (0, 0)):
    raise GraphError("InvalidArgument", message)


def fail(message: str, code: str = "InvalidArgument") -> Column:
    return F.raise_error(F.lit(f"{RAISED}{code}: {message}{RAISED}"))


def guard(broken: Column, message: str, col: Column, t: Type, code: str = "InvalidArgument") -> Column:
    """col, or an error where ``broken`` is true."""
    return F.when(broken, fail(message, code).cast(ddl(t))).otherwise(col)


def null_of(t: Type) -> Column:
    return F.lit(None) if t.kind == "null" else F.lit(None).cast(ddl(t))


def unify(a: Type, b: Type, what: str = "values") -> Type:
    """The type that holds both."""
    if a == b or b.kind == "null":
        return a
    if a.kind == "null":
        return b
    if a.kind in NUMBERS and b.kind in NUMBERS:
        return FLOAT
    if a.kind == b.kind == "list":
        return list_of(unify(a.elem or NULL, b.elem or NULL, what))
    if a.kind == b.kind == "map":
        x, y = dict(a.fields), dict(b.fields)
        fields = {k: unify(x.get(k, NULL), y.get(k, NULL), what) for k in {*x, *y}}
        return map_of(fields | ({KEYS: list_of(STRING)} if keys_of(a) != keys_of(b) else {}))
    if a.kind in MIXED and b.kind in MIXED and all(t.kind not in ("list", "map") or _in_json(t) for t in (a, b)):
        return ANY
    bad(f"{what} of kinds {a} and {b} can't be held in one column")


def as_type(v: Value, t: Type) -> Column:
    """v's column in a type that unify gave."""
    if v.type == t:
        return v.col
    if v.kind == "null":
        return null_of(t)
    if t.kind == "any":
        num = F.unix_date(v.col) if v.kind == "date" else F.lit(0) if v.kind in ("string", "list", "map") else v.col
        text = v.col if v.kind == "string" else _json_text(v) if v.kind in ("list", "map") else F.lit("")
        tagged = F.struct(F.lit(MIXED[v.kind]).alias("rank"), num.cast("double").alias("num"), text.alias("text"), F.lit(v.kind).alias("kind"))
        return F.when(v.col.isNotNull(), tagged)
    if t.kind == "list" and t.elem and v.type.elem:
        return F.transform(v.col, lambda e: as_type(Value(e, v.type.elem), t.elem)) if v.type.elem.kind != "null" else v.col.cast(ddl(t))
    if t.kind == "map":
        have = dict(v.type.fields)
        held = lambda k, x: own_keys(v) if k == KEYS else as_type(Value(v.col[k], have[k]), x) if k in have else null_of(x)
        return F.when(v.col.isNotNull(), F.struct(*[held(k, x).alias(k) for k, x in t.fields]))
    return v.col.cast(ddl(t))


def _json_text(v: Value) -> Column:
    """A list or map as JSON, with the keys that a map has and no others."""
    if v.type.kind == "list":
        each = F.transform(v.col, lambda e: F.coalesce(_json_text(Value(e, v.type.elem or NULL)), F.lit("null")))
        return F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))
    if v.type.kind == "map":
        entry = lambda k, t: F.concat(F.to_json(F.array(F.lit(k))).substr(F.lit(2), F.char_length(F.to_json(F.array(F.lit(k)))) - 2), F.lit(":"), F.coalesce(_json_text(Value(v.col[k], t)), F.lit("null")))
        parts = [F.when(F.array_contains(own_keys(v), k), entry(k, t)) for k, t in v.type.fields if k != KEYS]
        return F.when(v.col.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts) if parts else F.lit(""), F.lit("}")))
    if v.type.kind == "null":
        return F.lit(None).cast("string")
    one = F.to_json(F.array(v.col))
    return F.when(v.col.isNotNull(), one.substr(F.lit(2), F.char_length(one) - 2))


def from_spark(t: T.DataType) -> Type:
    """The type of a loaded column."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, T.BinaryType):
        return BYTES
    if isinstance(t, T.DateType):
        return DATE
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(t, T.ArrayType):
        return list_of(from_spark(t.elementType))
    if isinstance(t, T.StructType):
        names = tuple(f.name for f in t.fields)
        if names == ("nanos", "off"):
            return DATETIME
        if names == ("months", "days", "nanos"):
            return DURATION
        if names == ("nodes", "edges"):
            return PATH
        if names == ("rank", "num", "text", "kind"):
            return ANY
        return map_of({f.name: from_spark(f.dataType) for f in t.fields})
    if isinstance(t, T.NullType):
        return NULL
    raise GraphError("InvalidArgument", f"columns of type {t.simpleString()} aren't supported")


def loaded(col: Column, t: T.DataType) -> Column:
    """A loaded column in the form used here; timestamps become instants without an offset."""
    if isinstance(t, T.TimestampNTZType):
        return loaded(col.cast("timestamp"), T.TimestampType())
    if isinstance(t, T.TimestampType):
        return F.when(col.isNotNull(), F.struct((F.unix_micros(col) * 1000).alias("nanos"), F.lit(None).cast("int").alias("off")))
    if isinstance(t, T.ArrayType):
        return F.transform(col, lambda x: loaded(x, t.elementType)) if from_spark(t.elementType).kind == "datetime" else col.cast(ddl(from_spark(t)))
    want = ddl(from_spark(t))
    return col if t.simpleString() == want else col.cast(want)
