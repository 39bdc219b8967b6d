"""Syntax tree of modules and expressions. Nodes are frozen: equal trees are equal and hashable."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class Lit(Expr):
    value: object
    kind: str  # String, Integer, Real, Boolean, OclVoid


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class TypeLit(Expr):
    metamodel: str
    name: str


@dataclass(frozen=True)
class Nav(Expr):
    source: Expr
    name: str


@dataclass(frozen=True)
class Bin(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Un(Expr):
    op: str
    operand: Expr


@dataclass(frozen=True)
class If(Expr):
    cond: Expr
    then: Expr
    other: Expr


@dataclass(frozen=True)
class Let(Expr):
    name: str
    type: str | None
    init: Expr
    body: Expr


@dataclass(frozen=True)
class TupleLit(Expr):
    parts: tuple[tuple[str, str | None, Expr], ...]


@dataclass(frozen=True)
class CollLit(Expr):
    kind: str  # Sequence, Set, Bag, OrderedSet
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MapLit(Expr):
    items: tuple[tuple[Expr, Expr], ...]


@dataclass(frozen=True)
class Lambda(Expr):
    param: str
    body: Expr


@dataclass(frozen=True)
class Call(Expr):
    """source.name(args) or source->name(args); source is None for name(args)."""

    source: Expr | None
    name: str
    args: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Iterate(Expr):
    source: Expr
    var: str
    acc: str
    acc_type: str | None
    init: Expr
    body: Expr


@dataclass(frozen=True)
class Param:
    name: str
    type: str


@dataclass(frozen=True)
class Helper:
    name: str
    context: str | None
    params: tuple[Param, ...] | None  # None: attribute helper (no parentheses)
    result: str
    body: Expr


@dataclass(frozen=True)
class Query:
    name: str
    body: Expr


@dataclass(frozen=True)
class SourcePattern:
    var: str
    type: str
    guard: Expr | None = None


@dataclass(frozen=True)
class Binding:
    feature: str
    value: Expr


@dataclass(frozen=True)
class TargetPattern:
    var: str
    type: str
    bindings: tuple[Binding, ...] = ()


@dataclass(frozen=True)
class Rule:
    """kind: matched, called (params, no sources) or lazy (one source)."""

    name: str
    kind: str
    sources: tuple[SourcePattern, ...]
    targets: tuple[TargetPattern, ...]
    params: tuple[Param, ...] = ()
    using: tuple[tuple[str, str | None, Expr], ...] = ()


@dataclass(frozen=True)
class Module:
    name: str
    targets: tuple[tuple[str, str], ...]  # alias, metamodel
    sources: tuple[tuple[str, str], ...]
    helpers: tuple[Helper, ...] = ()
    queries: tuple[Query, ...] = ()
    rules: tuple[Rule, ...] = ()
    paths: tuple[tuple[str, str], ...] = ()
    warnings: tuple[str, ...] = field(default=(), compare=False)

    def __post_init__(self):
        if not self.name or not self.targets or not self.sources:
            raise ValueError("a module needs a name, a source and a target metamodel")

    def helper(self, name: str) -> Helper | None:
        found = [h for h in self.helpers if h.name == name]
        return found[-1] if found else None


def children(e) -> list[Expr]:
    """Direct sub-expressions."""
    if isinstance(e, Nav):
        return [e.source]
    if isinstance(e, Bin):
        return [e.left, e.right]
    if isinstance(e, Un):
        return [e.operand]
    if isinstance(e, If):
        return [e.cond, e.then, e.other]
    if isinstance(e, Let):
        return [e.init, e.body]
    if isinstance(e, TupleLit):
        return [x for _, _, x in e.parts]
    if isinstance(e, CollLit):
        return list(e.items)
    if isinstance(e, MapLit):
        return [x for pair in e.items for x in pair]
    if isinstance(e, Lambda):
        return [e.body]
    if isinstance(e, Call):
        return ([e.source] if e.source is not None else []) + list(e.args)
    if isinstance(e, Iterate):
        return [e.source, e.init, e.body]
    return []


def free_vars(e) -> frozenset[str]:
    if isinstance(e, Var):
        return frozenset({e.name})
    if isinstance(e, Lambda):
        return free_vars(e.body) - {e.param}
    if isinstance(e, Let):
        return free_vars(e.init) | (free_vars(e.body) - {e.name})
    if isinstance(e, Iterate):
        return free_vars(e.source) | free_vars(e.init) | (free_vars(e.body) - {e.var, e.acc})
    return frozenset().union(*(free_vars(x) for x in children(e)))
