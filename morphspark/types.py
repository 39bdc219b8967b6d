"""Types of expressions: scalars by name, collections, tuples, maps and classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from morphspark.errors import TypeMismatch

STRING, INTEGER, REAL, BOOLEAN, VOID, ANY = "String", "Integer", "Real", "Boolean", "OclVoid", "OclAny"
KINDS = ("Sequence", "Set", "Bag", "OrderedSet")


@dataclass(frozen=True)
class CollType:
    kind: str
    element: object


@dataclass(frozen=True)
class TupleType:
    fields: tuple[tuple[str, object], ...]

    def get(self, name: str):
        return dict(self.fields).get(name)


@dataclass(frozen=True)
class MapType:
    key: object
    value: object


@dataclass(frozen=True)
class ClassType:
    name: str


def from_spark(t: T.DataType):
    """The type of a column: 32-bit integers count as Integer, all else that has no name here is OclAny."""
    if isinstance(t, T.StringType):
        return STRING
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return REAL
    if isinstance(t, T.BooleanType):
        return BOOLEAN
    if isinstance(t, T.ArrayType):
        return CollType("Sequence", from_spark(t.elementType))
    if isinstance(t, T.MapType):
        return MapType(from_spark(t.keyType), from_spark(t.valueType))
    if isinstance(t, T.StructType):
        return TupleType(tuple((f.name, from_spark(f.dataType)) for f in t))
    return ANY


def to_spark(t) -> str:
    if isinstance(t, CollType):
        return f"array<{to_spark(t.element)}>"
    if isinstance(t, MapType):
        return f"map<{to_spark(t.key)},{to_spark(t.value)}>"
    if isinstance(t, TupleType):
        return "struct<" + ",".join(f"`{n}`:{to_spark(x)}" for n, x in t.fields) + ">"
    return {STRING: "string", INTEGER: "bigint", REAL: "double", BOOLEAN: "boolean", VOID: "string"}.get(t, "string")


def parse(text: str | None):
    """A type as written: Integer, Sequence(String), TupleType(a:Integer), MM!Class."""
    if text is None:
        return ANY
    if "!" in text and "(" not in text:
        return ClassType(text.split("!")[1])
    if "(" in text:
        kind, inner = text.split("(", 1)
        inner = inner.rsplit(")", 1)[0]
        if kind in ("TupleType", "Tuple"):
            return TupleType(tuple((n.strip(), parse(x.strip())) for n, x in (p.split(":", 1) for p in _split(inner))))
        if kind == "Map":
            k, v = _split(inner)
            return MapType(parse(k), parse(v))
        return CollType("Sequence" if kind == "Collection" else kind, parse(inner))
    return {"Float": REAL, "Double": REAL, "Int": INTEGER}.get(text, text)


def _split(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]] if text[at:].strip() else out


def numeric(t) -> bool:
    return t in (INTEGER, REAL, ANY, VOID)


def join(a, b):
    """The type that holds values of both."""
    if a == b or b in (VOID, ANY):
        return a
    if a in (VOID, ANY):
        return b
    if {a, b} == {INTEGER, REAL}:
        return REAL
    if isinstance(a, CollType) and isinstance(b, CollType):
        return CollType(a.kind, join(a.element, b.element))
    if isinstance(a, TupleType) and isinstance(b, TupleType) and [n for n, _ in a.fields] == [n for n, _ in b.fields]:
        return TupleType(tuple((n, join(x, y)) for (n, x), (_, y) in zip(a.fields, b.fields)))
    raise TypeMismatch(f"{a} and {b} have no common type")


def signature(name: str, types: list) -> str:
    """name(Type,...) as used in messages."""
    shown = [x if isinstance(x, str) else x.kind if isinstance(x, CollType) else x.name if isinstance(x, ClassType) else type(x).__name__ for x in types]
    return f"{name}({','.join(shown)})"
