"""Collection operators over array columns (higher-order functions, no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import functions as F

from morphspark import types as ty
from morphspark.types import ANY, BOOLEAN, INTEGER, REAL, CollType, MapType, TupleType

ITERATORS = frozenset("select reject collect exists forAll one any sortedBy isUnique".split())


def _unique(kind: str) -> bool:
    return kind in ("Set", "OrderedSet")


def _fit(c, t: CollType):
    return F.array_distinct(c) if _unique(t.kind) else c


def literal(kind: str, items: list, types: list):
    element = ANY
    for t in types:
        element = ty.join(element, t)
    t = CollType(kind, element)
    c = F.array(*[i.cast(ty.to_spark(element)) for i in items]) if items else F.array().cast(f"array<{ty.to_spark(element)}>")
    return _fit(c, t), t


def iterator(name: str, c, t: CollType, body):
    """body(element column) -> (column, type)."""
    seen: dict[str, object] = {}

    def test(x):
        col, seen["type"] = body(x)
        return col

    if name == "select":
        return F.filter(c, lambda x: F.coalesce(test(x), F.lit(False))), t
    if name == "reject":
        return F.filter(c, lambda x: F.coalesce(~test(x), F.lit(False))), t
    if name == "exists":
        return F.coalesce(F.exists(c, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False)), BOOLEAN
    if name == "forAll":
        return F.coalesce(F.forall(c, lambda x: F.coalesce(test(x), F.lit(True))), F.lit(True)), BOOLEAN
    if name == "one":
        return F.coalesce(F.size(F.filter(c, lambda x: F.coalesce(test(x), F.lit(False)))) == 1, F.lit(False)), BOOLEAN
    if name == "any":
        return F.get(F.filter(c, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(0)), t.element
    if name == "collect":
        mapped = F.transform(c, test)
        kind = "Sequence" if t.kind in ("Sequence", "OrderedSet") else "Bag"
        return F.filter(mapped, lambda x: x.isNotNull()), CollType(kind, seen["type"])
    if name == "isUnique":
        mapped = F.transform(c, test)
        return F.size(mapped) == F.size(F.array_distinct(mapped)), BOOLEAN
    if name == "sortedBy":
        keyed = F.transform(c, lambda x, i: F.struct(test(x).alias("k"), i.alias("i"), x.alias("x")))
        return F.transform(F.array_sort(keyed), lambda s: s["x"]), CollType("OrderedSet" if _unique(t.kind) else "Sequence", t.element)
    return None


def fold(c, init, init_type, body):
    """body(acc, x) -> (column, type): left fold in order."""
    kind = init_type

    def step(acc, x):
        return body(acc, x, kind)[0].cast(ty.to_spark(kind))

    # the accumulator's type is the join of its start and of what the body makes of it
    probe: dict[str, object] = {}

    def learn(acc, x):
        col, probe["type"] = body(acc, x, kind)
        return col.cast(ty.to_spark(kind))

    F.aggregate(c, init.cast(ty.to_spark(kind)), learn)
    kind = ty.join(init_type, probe["type"])
    return F.aggregate(c, init.cast(ty.to_spark(kind)), step), kind


def method(name: str, c, t: CollType, args: list, types: list):
    e = t.element
    size = F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    if name in ("size", "length"):
        return size, INTEGER
    if name == "isEmpty":
        return size == 0, BOOLEAN
    if name == "notEmpty":
        return size > 0, BOOLEAN
    if name == "first":
        return F.try_element_at(c, F.lit(1)), e
    if name == "last":
        return F.try_element_at(c, F.lit(-1)), e
    if name == "at":
        return F.get(c, args[0].cast("int") - 1), e
    if name == "includes":
        return F.coalesce(F.exists(c, lambda x: x.eqNullSafe(args[0])), F.lit(False)), BOOLEAN
    if name == "excludes":
        return ~F.coalesce(F.exists(c, lambda x: x.eqNullSafe(args[0])), F.lit(False)), BOOLEAN
    if name == "includesAll":
        return F.size(F.array_except(args[0], c)) == 0, BOOLEAN
    if name == "excludesAll":
        return F.size(F.array_intersect(c, args[0])) == 0, BOOLEAN
    if name == "count":
        return F.size(F.filter(c, lambda x: x.eqNullSafe(args[0]))).cast("bigint"), INTEGER
    if name == "union":
        kind = t.kind if t.kind == types[0].kind or t.kind in ("Sequence", "OrderedSet") else "Bag"
        out = CollType(kind, ty.join(e, types[0].element))
        return _fit(F.concat(c, args[0]), out), out
    if name == "intersection":
        if _unique(t.kind):
            return F.array_intersect(c, args[0]), t
        return F.filter(c, lambda x: F.array_contains(args[0], x)), t
    if name in ("difference", "-"):
        if _unique(t.kind):
            return F.array_except(c, args[0]), t
        return F.filter(c, lambda x: ~F.array_contains(args[0], x)), t
    if name == "symmetricDifference":
        return F.array_union(F.array_except(c, args[0]), F.array_except(args[0], c)), CollType("Set", e)
    if name in ("including", "append"):
        return _fit(F.array_append(c, args[0].cast(ty.to_spark(e)) if e != ANY else args[0]), t), CollType(t.kind, ty.join(e, types[0]))
    if name == "prepend":
        return _fit(F.array_prepend(c, args[0]), t), t
    if name == "insertAt":
        return F.array_insert(c, args[0].cast("int"), args[1]), t
    if name == "excluding":
        return F.filter(c, lambda x: ~x.eqNullSafe(args[0])), t
    if name == "flatten":
        if isinstance(e, CollType):
            return _fit(F.flatten(c), CollType(t.kind, e.element)), CollType(t.kind, e.element)
        return c, t
    if name in ("asSequence", "asBag"):
        return c, CollType(name[2:], e)
    if name in ("asSet", "asOrderedSet"):
        return F.array_distinct(c), CollType(name[2:], e)
    if name in ("subSequence", "subOrderedSet"):
        low = args[0].cast("int")
        return F.slice(c, low, F.greatest(args[1].cast("int") - low + 1, F.lit(0))), t
    if name == "indexOf":
        return F.array_position(c, args[0]).cast("bigint"), INTEGER
    if name == "sum":
        kind = REAL if e == REAL else INTEGER
        zero = F.lit(0.0 if kind == REAL else 0).cast(ty.to_spark(kind))
        return F.aggregate(c, zero, lambda a, x: a + x), kind
    if name == "product":
        one = F.lit(1).cast(ty.to_spark(e))
        return F.aggregate(c, one, lambda a, x: a * x), e
    if name == "max":
        return F.array_max(c), e
    if name == "min":
        return F.array_min(c), e
    if name == "avg":
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c), REAL
    if name == "isUnique":
        return F.size(c) == F.size(F.array_distinct(c)), BOOLEAN
    if name == "reverse":
        return F.reverse(c), t
    if name == "join":
        return F.array_join(c, args[0]), ty.STRING
    if name == "oclIsUndefined":
        return c.isNull(), BOOLEAN
    if name == "toString":
        return c.cast("string"), ty.STRING
    if name in ("exists", "forAll", "one", "any", "select", "reject", "collect"):  # without a body
        return {"exists": (size > 0, BOOLEAN), "forAll": (F.lit(True), BOOLEAN), "one": (size == 1, BOOLEAN), "any": (F.get(c, F.lit(0)), e)}.get(name, (c, t))
    return None


def map_method(name: str, c, t: MapType, args: list, types: list):
    if name in ("get", "at"):
        return F.try_element_at(c, args[0]), t.value
    if name == "size":
        return F.size(c).cast("bigint"), INTEGER
    if name == "isEmpty":
        return F.size(c) == 0, BOOLEAN
    if name == "notEmpty":
        return F.size(c) > 0, BOOLEAN
    if name == "getKeys":
        return F.map_keys(c), CollType("Set", t.key)
    if name == "getValues":
        return F.map_values(c), CollType("Bag", t.value)
    if name in ("containsKey", "includesKey"):
        return F.map_contains_key(c, args[0]), BOOLEAN
    if name in ("including", "put"):
        rest = F.map_filter(c, lambda k, _: k != args[0])
        return F.map_concat(rest, F.create_map(args[0], args[1])), t
    return None


def tuple_field(c, t: TupleType, name: str):
    return c.getField(name), t.get(name)
