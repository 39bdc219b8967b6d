"""What an expression lowers to: columns, elements, tuples, and collections that are still tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphspark import types as ty
from morphspark.errors import InvalidOperation


class Frame:
    """Rows under construction: a DataFrame whose columns are prefix__feature, and the joins made so far."""

    def __init__(self, df: DataFrame, rowid: list[str], joined: dict | None = None):
        self.df, self.rowid, self.joined, self._n = df, rowid, dict(joined or {}), 0

    def fresh(self, stem: str) -> str:
        taken = set(self.df.columns)
        while True:
            self._n += 1
            name = f"{stem}${self._n}"
            if name not in taken and not any(c.startswith(f"{name}__") for c in taken):
                return name

    def copy(self) -> Frame:
        return Frame(self.df, list(self.rowid), self.joined)


@dataclass
class V:
    """A column and its type; ``node`` is set for a value known on the driver."""

    col: Column
    type: object


@dataclass
class TupleV:
    fields: dict[str, object]


@dataclass
class ObjV:
    """An element: its columns are prefix__feature once ``link`` (the key that points to it) has been joined."""

    prefix: str
    cls: str
    alias: str
    key: Column | None
    loaded: bool = True


@dataclass
class SetV:
    """A collection that is a table: ``frame`` holds a row per element.

    link: (column of the parent frame, column of this frame) pairs; empty for a collection of its own.
    correlated: the frame already holds the parent's columns, its rows belong to parent.rowid.
    """

    frame: Frame
    element: object
    kind: str = "Bag"
    parent: Frame | None = None
    link: list[tuple[str, str]] = field(default_factory=list)
    correlated: bool = False
    order: list[Column] = field(default_factory=list)

    def group(self) -> list[str]:
        return list(self.parent.rowid) if self.correlated else [c for _, c in self.link]

    def but(self, **changes) -> SetV:
        return replace(self, **changes)


@dataclass
class TypeV:
    alias: str
    cls: str


@dataclass
class ModuleV:
    """thisModule."""


def column(v) -> Column:
    """The value as one column; an element is its key."""
    if isinstance(v, V):
        return v.col
    if isinstance(v, ObjV):
        if v.key is None:
            raise InvalidOperation(f"an element of {v.cls} has no key")
        return v.key
    if isinstance(v, TupleV):
        return F.struct(*[column(x).alias(n) for n, x in v.fields.items()])
    if isinstance(v, TypeV):
        return F.lit(v.cls)
    raise InvalidOperation("a collection of rows where a single value is wanted")


def type_of(v):
    if isinstance(v, V):
        return v.type
    if isinstance(v, ObjV):
        return ty.ClassType(v.cls)
    if isinstance(v, TupleV):
        return ty.TupleType(tuple((n, type_of(x)) for n, x in v.fields.items()))
    if isinstance(v, SetV):
        return ty.CollType(v.kind, type_of(v.element))
    return ty.STRING
