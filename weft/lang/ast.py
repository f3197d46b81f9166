"""The syntax tree. Positions are (line, column) of the first token."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Node:
    pos: tuple[int, int] = field(default=(0, 0), kw_only=True, compare=False, repr=False)


# ------------------------------------------------------------------------------------------------------- expressions
@dataclass
class Lit(Node):
    value: object  # None, bool, int, float or str


@dataclass
class Param(Node):
    name: str


@dataclass
class Var(Node):
    name: str


@dataclass
class Prop(Node):
    base: Node
    key: str


@dataclass
class Index(Node):
    base: Node
    at: Node


@dataclass
class Slice(Node):
    base: Node
    lo: Node
    hi: Node | None


@dataclass
class ListLit(Node):
    items: list[Node]


@dataclass
class MapLit(Node):
    entries: list[tuple[str, Node]]


@dataclass
class Unary(Node):
    op: str  # + - NOT
    x: Node


@dataclass
class Binary(Node):
    op: str
    a: Node
    b: Node


@dataclass
class IsNull(Node):
    x: Node
    negated: bool


@dataclass
class IsType(Node):
    x: Node
    negated: bool
    type: str


@dataclass
class Comprehension(Node):
    var: str
    source: Node
    where: Node | None
    body: Node | None


@dataclass
class Quantifier(Node):
    kind: str
    var: str
    source: Node
    where: Node


@dataclass
class Reduce(Node):
    acc: str
    init: Node
    var: str
    source: Node
    body: Node


@dataclass
class Case(Node):
    base: Node | None
    whens: list[tuple[Node, Node]]
    otherwise: Node | None


@dataclass
class Call(Node):
    name: str
    args: list[Node]
    distinct: bool = False
    star: bool = False


# ---------------------------------------------------------------------------------------------------------- patterns
@dataclass
class NodePat(Node):
    name: str | None
    labels: list[list[str]]  # every group is required, one name of each suffices
    props: MapLit | None


@dataclass
class RelPat(Node):
    name: str | None
    types: list[str]
    direction: str  # out, in, both
    length: tuple[int, int | None] | None  # None: one hop; (least, most or None for open)
    props: MapLit | None
    written: str = ""  # the length as written


@dataclass
class Path(Node):
    name: str | None
    parts: list[Node]  # node, relationship, node, ...
    shortest: str | None = None  # shortestPath, allShortestPaths


# ----------------------------------------------------------------------------------------------------------- clauses
@dataclass
class Match(Node):
    paths: list[Path]
    where: Node | None
    optional: bool = False


@dataclass
class Unwind(Node):
    source: Node
    name: str


@dataclass
class Item(Node):
    expr: Node
    alias: str | None


@dataclass
class SortKey(Node):
    expr: Node
    descending: bool
    nulls: str | None


@dataclass
class Projection(Node):
    keyword: str  # WITH or RETURN
    distinct: bool
    star: bool
    items: list[Item]
    order: list[SortKey]
    skip: Node | None
    limit: Node | None
    where: Node | None = None


@dataclass
class CallProc(Node):
    name: str
    args: list[Node]
    yields: list[tuple[str, str | None]] | None
    where: Node | None


@dataclass
class Create(Node):
    paths: list[Path]


@dataclass
class SetItem(Node):
    kind: str  # prop, replace, merge, labels
    name: str
    key: str | None = None
    value: Node | None = None
    labels: list[str] | None = None


@dataclass
class SetClause(Node):
    items: list[SetItem]


@dataclass
class Merge(Node):
    path: Path
    on_create: list[SetItem]
    on_match: list[SetItem]


@dataclass
class Remove(Node):
    items: list[SetItem]


@dataclass
class Delete(Node):
    detach: bool
    items: list[Node]


# -------------------------------------------------------------------------------------------------------- statements
@dataclass
class Query(Node):
    parts: list[list[Node]]  # single queries
    unions: list[bool]  # between them: whether ALL


@dataclass
class Explain(Node):
    query: Query
    profile: bool


@dataclass
class Begin(Node):
    read_only: bool


@dataclass
class Command(Node):
    """Statements without rows of their own: COMMIT, ROLLBACK, VACUUM, ANALYZE, USE, SHOW, DDL and access control."""

    kind: str
    args: dict = field(default_factory=dict)
