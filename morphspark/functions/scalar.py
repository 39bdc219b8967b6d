"""Methods of strings, numbers and any value, as columns: name -> (columns, types) -> (column, type)."""

from __future__ import annotations

from pyspark.sql import functions as F

from morphspark import types as ty
from morphspark.errors import TypeMismatch
from morphspark.types import ANY, BOOLEAN, INTEGER, REAL, STRING, VOID, CollType


def _want(t, *allowed) -> None:
    if t not in (*allowed, ANY, VOID):
        raise TypeMismatch(f"{t} where {' or '.join(allowed)} is wanted")


def _int(c):
    return c.cast("bigint")


def _real_text(c, t):
    return F.coalesce(c.cast("string"), F.lit("null"))


def _string(name: str, c, args: list, types: list):
    lower = {"toLowerCase", "toLower"}
    if name in ("toUpperCase", "toUpper"):
        return F.upper(c), STRING
    if name in lower:
        return F.lower(c), STRING
    if name == "size":
        return _int(F.length(c)), INTEGER
    if name == "isEmpty":
        return F.coalesce(F.length(c) == 0, F.lit(True)), BOOLEAN
    if name == "notEmpty":
        return F.coalesce(F.length(c) > 0, F.lit(False)), BOOLEAN
    if name == "reverse":
        return F.reverse(c), STRING
    if name == "trim":
        return F.trim(c), STRING
    if name == "concat":
        _want(types[0], STRING)
        return F.concat(c, args[0]), STRING
    if name == "substring":
        low = args[0].cast("int")
        length = args[1].cast("int") - low + 1 if len(args) > 1 else F.length(c)
        return F.substring(c, low, length), STRING
    if name == "at":
        return F.substring(c, args[0].cast("int"), F.lit(1)), STRING
    if name == "indexOf":
        return _int(F.instr(c, args[0])), INTEGER
    if name == "startsWith":
        return c.startswith(args[0]), BOOLEAN
    if name == "endsWith":
        return c.endswith(args[0]), BOOLEAN
    if name in ("contains", "includes"):
        return c.contains(args[0]), BOOLEAN
    if name == "split":
        return F.split(c, F.concat(F.lit("\\Q"), args[0], F.lit("\\E"))), CollType("Sequence", STRING)
    if name == "replaceAll":
        return F.replace(c, args[0], args[1]), STRING
    if name == "toInteger":
        return _int(c), INTEGER
    if name == "toReal":
        return c.cast("double"), REAL
    if name == "toBoolean":
        return c == "true", BOOLEAN
    return None


def _number(name: str, c, t, args: list, types: list):
    if name in ("mod", "isEven", "isOdd", "square", "power", "div", "factorial"):
        if name in ("mod", "isEven", "power", "square"):
            _want(t, INTEGER) if name != "square" else _want(t, INTEGER, REAL)
        if name == "mod":
            _want(types[0], INTEGER)
            return c % args[0], INTEGER
        if name == "div":
            return _int(F.try_divide(c, args[0])) if t == REAL else F.call_function("div", c, args[0]), INTEGER
        if name == "isEven":
            return c % 2 == 0, BOOLEAN
        if name == "isOdd":
            return c % 2 != 0, BOOLEAN
        if name == "square":
            return c * c, t
        if name == "power":
            _want(types[0], INTEGER)
            checked = F.when(args[0] < 0, F.raise_error(F.lit("power: negative exponent")).cast("double")).otherwise(F.pow(c, args[0]))
            return _int(checked), INTEGER
        return None
    if name == "abs":
        return F.abs(c), t
    if name == "floor":
        return _int(F.floor(c)), INTEGER
    if name == "ceiling":
        return _int(F.ceil(c)), INTEGER
    if name == "round":
        return _int(F.round(c)), INTEGER
    if name == "sqrt":
        return F.sqrt(c), REAL
    if name == "max":
        return F.greatest(c, args[0]), ty.join(t, types[0])
    if name == "min":
        return F.least(c, args[0]), ty.join(t, types[0])
    if name in ("toReal",):
        return c.cast("double"), REAL
    if name in ("toInteger",):
        return _int(c), INTEGER
    return None


def method(name: str, c, t, args: list, types: list):
    """(column, type) of a scalar's method, or None if there is none of that name."""
    if name == "oclIsUndefined":
        return c.isNull(), BOOLEAN
    if name == "toString":
        return _real_text(c, t), STRING
    if t in (STRING, VOID) or t == ANY and name not in ("max", "min", "mod", "div", "abs", "floor", "round"):
        found = _string(name, c, args, types)
        if found is not None:
            return found
    if t in (INTEGER, REAL, ANY, VOID):
        found = _number(name, c, t, args, types)
        if found is not None:
            return found
    if name in ("toUpperCase", "toLowerCase", "reverse", "mod", "isEven", "power", "square"):
        raise TypeMismatch(ty.signature(name, [t, *types]))
    if t == BOOLEAN and name in ("and", "or", "xor", "implies"):
        a, b = c, args[0]
        return {"and": a & b, "or": a | b, "xor": a != b, "implies": ~a | b}[name], BOOLEAN
    return None


def binary(op: str, a, ta, b, tb):
    """(column, type) of an infix operator by the operands' types."""
    if op in ("and", "or", "xor", "implies"):
        for t in (ta, tb):
            _want(t, BOOLEAN)
        return {"and": a & b, "or": a | b, "xor": a != b, "implies": ~a | b}[op], BOOLEAN
    if op in ("=", "<>"):
        if ta not in (ANY, VOID) and tb not in (ANY, VOID) and ta != tb and {ta, tb} != {INTEGER, REAL} and isinstance(ta, str) and isinstance(tb, str):
            raise TypeMismatch(f"{ta} {op} {tb}")
        if isinstance(ta, CollType) and isinstance(tb, CollType) and not {"Set", "Bag"}.isdisjoint((ta.kind, tb.kind)):
            a, b = F.array_sort(a), F.array_sort(b)
        return (a == b if op == "=" else a != b), BOOLEAN
    if op in ("<", ">", "<=", ">="):
        if ta not in (ANY, VOID) and tb not in (ANY, VOID) and ta != tb and {ta, tb} != {INTEGER, REAL}:
            raise TypeMismatch(f"{ta} {op} {tb}")
        return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op], BOOLEAN
    if op == "+" and STRING in (ta, tb):
        _want(ta, STRING)
        _want(tb, STRING)
        return F.concat(a, b), STRING
    for t in (ta, tb):
        _want(t, INTEGER, REAL)
    if op == "/":
        return a.cast("double") / b.cast("double"), REAL
    if op == "div":
        return F.call_function("div", a, b), INTEGER
    if op == "mod":
        return a % b, INTEGER
    return {"+": a + b, "-": a - b, "*": a * b}[op], ty.join(ta, tb)
