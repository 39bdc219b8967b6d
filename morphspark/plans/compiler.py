"""Lowers expressions to DataFrame plans.

Collections rooted at an extent or a to-many reference stay tables: select is a
filter, collect a projection, quantifiers and folds are grouped aggregates that a
left join (in guards: a semi or anti join) brings back to the rows they belong to.
Collections held in a column are handled by higher-order functions. Navigation to
one element is a left join, made once per path and only if a feature is read.
Nothing runs here; Catalyst plans and executes. The exception is a helper that calls
itself on other elements: it is solved for all elements of its class, level by level.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import fields, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, NumericType

from morphspark import types as ty
from morphspark.errors import InvalidOperation, MorphError, TypeMismatch, UnknownFeature, UnknownHelper, UnknownOperation, UnknownVariable
from morphspark.evaluate import Evaluator, Unique
from morphspark.functions import collections as fc
from morphspark.functions import scalar as fs
from morphspark.lang import ast as A
from morphspark.metamodel import Attribute, Model
from morphspark.operators.ranks import MERGE, global_rank, totals_upto
from morphspark.plans.values import Frame, ModuleV, ObjV, SetV, TupleV, TypeV, V, column, type_of


#: Levels of elements that a recursive helper may pass.
LEVELS = 200
#: Comparisons with their sides exchanged, and their opposites.
SWAPPED = {"=": "=", "<>": "<>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}
OPPOSITE = {"=": "<>", "<>": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
COUNTS = {"size": lambda n: n, "count": lambda n: n, "isEmpty": lambda n: n == 0, "forAll": lambda n: n == 0, "notEmpty": lambda n: n > 0, "exists": lambda n: n > 0, "one": lambda n: n == 1}


def literal(v):
    """A driver value as a constant column."""
    if v is None:
        return V(F.lit(None), ty.VOID)
    if isinstance(v, bool):
        return V(F.lit(v), ty.BOOLEAN)
    if isinstance(v, int):
        return V(F.lit(v).cast("bigint"), ty.INTEGER)
    if isinstance(v, float):
        return V(F.lit(v), ty.REAL)
    if isinstance(v, str):
        return V(F.lit(v), ty.STRING)
    if isinstance(v, list):
        items = [literal(x) for x in v]
        c, t = fc.literal("Set" if isinstance(v, Unique) else "Sequence", [column(i) for i in items], [type_of(i) for i in items])
        return V(c, t)
    if isinstance(v, dict):
        return TupleV({k: literal(x) for k, x in v.items()})
    raise InvalidOperation(f"no column for {type(v).__name__}")


def packed(c: Column, order: list[Column]) -> Column:
    """An aggregate: the values (no nulls) as an array by ``order``, else by themselves."""
    if not order:
        return F.array_sort(F.collect_list(c))
    rows = F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], c.alias("x")))
    return F.filter(F.transform(F.array_sort(rows), lambda s: s["x"]), lambda x: x.isNotNull())


class Compiler:
    def __init__(self, module: A.Module | None, models: dict[str, Model], registered: dict | None = None, rules=None):
        self.module, self.models, self.registered, self.rules = module, models, registered or {}, rules
        self.evaluator = Evaluator(module)
        self.inlining: list[str] = []
        #: How often each helper was put in place and each class navigated to.
        self.uses: Counter[str] = Counter()
        #: Helpers being solved: the values known so far of each element (key, value) and their type.
        self.solving: dict[str, tuple[DataFrame, object]] = {}
        self.solved: dict[tuple[str, str], tuple[DataFrame, object]] = {}

    # models

    def model(self, name: str) -> tuple[str, Model]:
        for alias, m in self.models.items():
            if name in (alias, m.metamodel.name):
                return alias, m
        raise UnknownVariable(f"no model {name}")

    def class_type(self, text: str) -> tuple[str, str]:
        """(alias, class) of MM!Class, or of a bare class name in any model."""
        if "!" in text:
            mm, cls = text.split("!")
            return self.model(mm)[0], cls
        for alias, m in self.models.items():
            if text in m.metamodel.classes:
                return alias, text
        raise UnknownVariable(text)

    def scan(self, alias: str, cls: str, prefix: str) -> tuple[Frame, ObjV]:
        model = self.models[alias]
        key = model.metamodel.key(cls)
        frame = Frame(model.extent(cls, prefix), [f"{prefix}__{key}"] if key else [])
        return frame, ObjV(prefix, cls, alias, F.col(f"{prefix}__{key}") if key else None)

    def extent(self, alias: str, cls: str) -> SetV:
        frame, obj = self.scan(alias, cls, self._prefix(cls))
        return SetV(frame, obj, "Set", order=self._order(obj))

    def _prefix(self, cls: str) -> str:
        self._count = getattr(self, "_count", 0) + 1
        return f"{cls.lower()}{self._count}"

    def _order(self, obj: ObjV) -> list[Column]:
        c = self.models[obj.alias].metamodel.cls(obj.cls)
        names = c.order or ((self.models[obj.alias].metamodel.key(obj.cls),) if self.models[obj.alias].metamodel.key(obj.cls) else ())
        return [F.col(f"{obj.prefix}__{n}") for n in names]

    # expressions

    def constant(self, e: A.Expr) -> bool:
        """Whether the driver alone can evaluate e: literals, helpers of literals, no rows."""
        if isinstance(e, A.TypeLit) or A.free_vars(e) - {"thisModule"}:
            return False
        names, todo, seen = [], [e], set()
        while todo:
            x = todo.pop()
            if isinstance(x, (A.Call, A.Nav)):
                names.append(x.name)
            if isinstance(x, A.TypeLit):
                return False
            todo += A.children(x)
            while names:
                n = names.pop()
                if n in ("resolveTemp", "allInstances") or n in self.registered or self.rules and self.rules.named(n):
                    return False
                if n not in seen and self.module:
                    seen.add(n)
                    h = self.module.helper(n)
                    q = next((q for q in self.module.queries if q.name == n), None)
                    if h or q:
                        todo.append((h or q).body)
        return True

    def lower(self, e: A.Expr, env: dict, frame: Frame | None):
        if isinstance(e, (A.Call, A.Nav, A.Iterate, A.CollLit)) and self.constant(e):
            return literal(self.evaluator.eval(e))
        match e:
            case A.Lit():
                return literal(e.value)
            case A.Var(name):
                if name in env:
                    return env[name]
                if name == "thisModule":
                    return ModuleV()
                raise UnknownVariable(name)
            case A.TypeLit(mm, cls):
                alias, model = self.model(mm)
                model.metamodel.cls(cls)
                return TypeV(alias, cls)
            case A.Nav():
                return self.navigate(self.lower(e.source, env, frame), e.name, frame, env)
            case A.Bin():
                return self.binary(e.op, self.held(self.lower(e.left, env, frame), frame), self.held(self.lower(e.right, env, frame), frame))
            case A.Un(op, operand):
                v = self.lower(operand, env, frame)
                t = type_of(v)
                if op == "not":
                    if t not in (ty.BOOLEAN, ty.ANY, ty.VOID):
                        raise TypeMismatch(f"not {t}")
                    return V(~column(v), ty.BOOLEAN)
                if not ty.numeric(t):
                    raise TypeMismatch(f"-{t}")
                return V(-column(v), t)
            case A.If():
                c, a, b = (self.lower(x, env, frame) for x in (e.cond, e.then, e.other))
                return self.choose(column(c), a, b)
            case A.Let(name, _, init, body):
                return self.lower(body, {**env, name: self.lower(init, env, frame)}, frame)
            case A.TupleLit(parts):
                return TupleV({n: self.held(self.lower(x, env, frame), frame) for n, _, x in parts})
            case A.CollLit(kind, items):
                values = [self.held(self.lower(x, env, frame), frame) for x in items]
                c, t = fc.literal(kind, [column(v) for v in values], [type_of(v) for v in values])
                return V(c, t)
            case A.MapLit(items):
                pairs = [(self.lower(k, env, frame), self.lower(v, env, frame)) for k, v in items]
                kt = reduce(ty.join, [type_of(k) for k, _ in pairs], ty.ANY)
                vt = reduce(ty.join, [type_of(v) for _, v in pairs], ty.ANY)
                return V(F.create_map(*[column(x) for p in pairs for x in p]), ty.MapType(kt, vt))
            case A.Iterate():
                return self.iterate(e, env, frame)
            case A.Call():
                return self.call(e, env, frame)
        raise InvalidOperation(type(e).__name__)

    def choose(self, cond: Column, a, b):
        """if-then-else; a condition that is not true takes the else branch."""
        if isinstance(a, TupleV) and isinstance(b, TupleV) and list(a.fields) == list(b.fields):
            return TupleV({n: self.choose(cond, a.fields[n], b.fields[n]) for n in a.fields})
        t = ty.join(type_of(a), type_of(b))
        return V(F.when(cond, column(a).cast(ty.to_spark(t)) if t != type_of(a) else column(a)).otherwise(column(b).cast(ty.to_spark(t)) if t != type_of(b) else column(b)), t)

    def held(self, v, frame: Frame | None):
        """A collection of rows as a value of the row that it belongs to: an array column, in the collection's order."""
        if not isinstance(v, SetV) or frame is None:
            return v
        if isinstance(v.element, SetV):
            v = self.flatten(v)
        t = ty.CollType(v.kind, type_of(v.element))
        return V(column(self.aggregate(v, packed(column(v.element), v.order), t, F.array(), frame)), t)

    def binary(self, op: str, a, b):
        if isinstance(a, SetV) or isinstance(b, SetV):
            raise InvalidOperation(f"{op} of collections of rows")
        if isinstance(a, ObjV) or isinstance(b, ObjV):
            if op not in ("=", "<>"):
                raise TypeMismatch(f"{op} of elements")
            x, y = column(a), column(b)
            return V(x == y if op == "=" else x != y, ty.BOOLEAN)
        return V(*fs.binary(op, column(a), type_of(a), column(b), type_of(b)))

    def load(self, obj: ObjV, frame: Frame) -> None:
        """Join the element's columns, once per path."""
        if obj.loaded or frame is None or f"{obj.prefix}___class" in frame.df.columns:
            return
        model = self.models[obj.alias]
        key = model.metamodel.key(obj.cls)
        self.uses[f"navigation {obj.cls}"] += 1
        target = model.extent(obj.cls, obj.prefix)
        frame.df = frame.df.join(target, obj.key == target[f"{obj.prefix}__{key}"], "left")

    def navigate(self, v, name: str, frame: Frame | None, env: dict):
        if isinstance(v, ModuleV):
            return self.helper(name, None, [], env, frame)
        if isinstance(v, ObjV):
            mm = self.models[v.alias].metamodel
            f = mm.feature(v.cls, name)
            if isinstance(f, Attribute):
                self.load(v, frame)
                return V(F.col(f"{v.prefix}__{name}"), f.type)
            if f is not None and not f.many:
                self.load(v, frame)
                return ObjV(f"{v.prefix}_{name}", f.target, v.alias, F.col(f"{v.prefix}__${name}"), loaded=False)
            if f is not None:
                child, obj = self.scan(v.alias, f.target, self._prefix(f.target))
                back = mm.feature(f.target, f.opposite)
                key = mm.key(v.cls)
                here = f"{v.prefix}__{key}"
                if not v.loaded:
                    self.load(v, frame)
                return SetV(child, obj, "OrderedSet", frame, [(here, f"{obj.prefix}__${back.name}")], order=self._order(obj))
            return self.helper(name, v, [], env, frame, missing=UnknownFeature(f"{v.cls}.{name}"))
        if isinstance(v, TupleV):
            if name not in v.fields:
                raise UnknownFeature(name)
            return v.fields[name]
        if isinstance(v, SetV):
            return v.but(element=self.navigate(v.element, name, v.frame, env), kind="Bag")
        t = type_of(v)
        if isinstance(t, ty.TupleType) and t.get(name) is not None:
            return V(*fc.tuple_field(column(v), t, name))
        return self.helper(name, v, [], env, frame, missing=UnknownFeature(f"{t}.{name}"))

    # calls

    def call(self, e: A.Call, env: dict, frame: Frame | None):
        name = e.name
        if e.source is None:
            if self.rules and (rule := self.rules.named(name)):
                return self.rules.invoke(rule, [self.lower(a, env, frame) for a in e.args], self, frame)
            return self.helper(name, env.get("self"), [self.lower(a, env, frame) for a in e.args], env, frame)
        compared = self.compared(e, env, frame)
        if compared is not None:
            return compared
        v = self.lower(e.source, env, frame)
        if isinstance(v, ModuleV):
            args = [self.lower(a, env, frame) for a in e.args]
            if name == "resolveTemp":
                return self.rules.resolve(args[0], e.args[1].value, self, frame)
            if self.rules and (rule := self.rules.named(name)):
                return self.rules.invoke(rule, args, self, frame)
            return self.helper(name, None, args, env, frame)
        if isinstance(v, TypeV):
            if name == "allInstances":
                return self.extent(v.alias, v.cls)
            return self.scalar(name, V(column(v), ty.STRING), e, env, frame)
        if isinstance(v, SetV):
            return self.set_call(v, name, e.args, env, frame)
        if isinstance(v, ObjV):
            return self.object_call(v, name, e, env, frame)
        t = type_of(v)
        if isinstance(t, ty.CollType):
            return self.array_call(v, t, name, e, env, frame)
        if isinstance(t, ty.MapType):
            args = [self.lower(a, env, frame) for a in e.args]
            found = fc.map_method(name, column(v), t, [column(a) for a in args], [type_of(a) for a in args])
            if found:
                return V(*found)
        return self.scalar(name, v, e, env, frame)

    def scalar(self, name: str, v, e: A.Call, env: dict, frame: Frame | None):
        if name == "oclIsKindOf" or name == "oclIsTypeOf":
            wanted = e.args[0].name
            return literal(wanted in (type_of(v), ty.ANY) or wanted == ty.REAL and type_of(v) == ty.INTEGER and name == "oclIsKindOf")
        if name == "oclAsType":
            return v
        args = [self.lower(a, env, frame) for a in e.args]
        found = fs.method(name, column(v), type_of(v), [column(a) for a in args], [type_of(a) for a in args])
        if found is not None:
            return V(*found)
        if len(args) == 1 and name in ("and", "or", "xor", "implies", "mod", "div"):
            return self.binary(name, v, args[0])
        return self.helper(name, v, args, env, frame, missing=UnknownOperation(ty.signature(name, [type_of(v), *map(type_of, args)])))

    def array_call(self, v, t: ty.CollType, name: str, e: A.Call, env: dict, frame: Frame | None):
        c = column(v)
        if e.args and isinstance(e.args[0], A.Lambda):
            fn = e.args[0]

            def body(x):
                out = self.lower(fn.body, {**env, fn.param: V(x, t.element)}, frame)
                return column(out), type_of(out)

            found = fc.iterator(name, c, t, body)
        else:
            args = [self.lower(a, env, frame) for a in e.args]
            if self.rules and t.element == ty.STRING:  # ids of targets beside elements of the source
                args = [self.rules.resolve(a, None, self, frame) if isinstance(a, SetV) and isinstance(a.element, ObjV) else a for a in args]
            args = [self.held(a, frame) for a in args]
            found = fc.method(name, c, t, [column(a) for a in args], [type_of(a) for a in args])
            if found is None:
                return self.helper(name, v, args, env, frame, missing=UnknownOperation(f"{t.kind}.{name}"))
        if found is None:
            raise UnknownOperation(f"{t.kind}.{name}")
        return V(*found)

    def object_call(self, v: ObjV, name: str, e: A.Call, env: dict, frame: Frame | None):
        mm = self.models[v.alias].metamodel
        if name == "oclIsUndefined":
            self.load(v, frame)
            return V(F.col(f"{v.prefix}___class").isNull(), ty.BOOLEAN)
        if name in ("oclIsKindOf", "oclIsTypeOf"):
            target = self.lower(e.args[0], env, frame)
            wanted = target.cls if isinstance(target, TypeV) else None
            if name == "oclIsKindOf" and wanted in mm.lineage(v.cls):
                return literal(True)  # every element of the static type is one
            self.load(v, frame)
            names = mm.subtypes(wanted) if name == "oclIsKindOf" else [wanted]
            return V(F.coalesce(F.col(f"{v.prefix}___class").isin(names), F.lit(False)), ty.BOOLEAN)
        if name == "oclAsType":
            return ObjV(v.prefix, self.lower(e.args[0], env, frame).cls, v.alias, v.key, v.loaded)
        if name == "oclType":
            self.load(v, frame)
            return TupleV({"name": V(F.col(f"{v.prefix}___class"), ty.STRING)})
        if name == "toString":
            return V(F.coalesce(column(v).cast("string"), F.lit("null")), ty.STRING)
        return self.helper(name, v, [self.lower(a, env, frame) for a in e.args], env, frame)

    def helper(self, name: str, receiver, args: list, env: dict, frame: Frame | None, missing: MorphError | None = None):
        if name in self.registered:
            given = ([receiver] if receiver is not None else []) + args
            out = self.registered[name](*[column(a) for a in given])
            return out if isinstance(out, V) else V(out, ty.ANY)
        h = self._find(name, receiver)
        if h is None:
            raise missing or UnknownHelper(name)
        if isinstance(h, A.Query):
            return self.lower(h.body, {}, frame)
        self.uses[f"helper {name}"] += 1
        params = h.params or ()
        if len(params) != len(args):
            raise InvalidOperation(f"{name} takes {len(params)} arguments, not {len(args)}")
        if name in self.inlining or self._recurses(h):
            if isinstance(receiver, ObjV) and not args:
                known = self.solving.get(name) or self._solve(h, receiver)
                return self._lookup(known, receiver, frame)
            counted = self._counted(h, args, env, frame) if receiver is None or h.context is None else None
            return counted or self._recursive(h, receiver, args)
        self.inlining.append(name)
        try:
            scope = {p.name: a for p, a in zip(params, args)}
            if receiver is not None:
                scope["self"] = receiver
            return self.lower(h.body, scope, frame)
        finally:
            self.inlining.pop()

    def _find(self, name: str, receiver):
        """The helper of that name whose context fits the receiver; else the last one of that name; else a query."""
        if self.module is None:
            return None
        found = [h for h in self.module.helpers if h.name == name]
        fitting = [h for h in found if receiver is not None and h.context and self._fits(h.context, receiver)]
        if fitting or found:
            return (fitting or found)[-1]
        return next((q for q in self.module.queries if q.name == name), None)

    def _fits(self, context: str, v) -> bool:
        t = type_of(v)
        wanted = ty.parse(context)
        if isinstance(t, ty.ClassType):
            name = wanted.name if isinstance(wanted, ty.ClassType) else str(wanted)
            return isinstance(v, ObjV) and name in self.models[v.alias].metamodel.lineage(v.cls)
        return isinstance(t, ty.CollType) and isinstance(wanted, ty.CollType) or t == wanted

    def _recurses(self, h: A.Helper) -> bool:
        seen, todo = set(), [h.body]
        while todo:
            x = todo.pop()
            if isinstance(x, (A.Call, A.Nav)) and self.module and (found := self.module.helper(x.name)):
                if found.name == h.name:
                    return True
                if found.name not in seen:
                    seen.add(found.name)
                    todo.append(found.body)
            todo += A.children(x)
        return False

    def _solve(self, h: A.Helper, receiver: ObjV) -> tuple[DataFrame, object]:
        """(key, value) of a recursive helper for all elements of its context, and the value's type.

        Each round works the body out with the values of the round before (null at first), so the elements
        whose calls are answered gain theirs, a level a round; it ends when nothing changes. Every round is a
        job; its table is checkpointed where the session has a folder for that, else kept by Spark.
        """
        alias, cls = receiver.alias, h.context.split("!")[-1] if h.context and "!" in h.context else receiver.cls
        if (alias, h.name) in self.solved:
            return self.solved[alias, h.name]
        kind, before, rounds = ty.parse(h.result), None, []
        for _ in range(LEVELS):
            frame, obj = self.scan(alias, cls, self._prefix(cls))
            spark = frame.df.sparkSession
            if before is None:
                before = frame.df.select(column(obj).alias("key"), F.lit(None).cast(ty.to_spark(kind)).alias("value")).limit(0)
            self.solving[h.name] = (before, kind)
            try:
                value = self.lower(h.body, {"self": obj}, frame)
            finally:
                del self.solving[h.name]
            now = frame.df.select(column(obj).alias("key"), column(value).cast(ty.to_spark(kind)).alias("value"))
            now = now.checkpoint() if spark.sparkContext.getCheckpointDir() else now.persist()
            old = before.select("key", F.col("value").alias("old"))
            rounds.append(now)
            if not now.join(old, "key", "left").where(~F.col("value").eqNullSafe(F.col("old"))).head(1):
                for earlier in rounds[:-1]:
                    earlier.unpersist()
                if not self.solving:  # else it holds for this round of another helper only
                    self.solved[alias, h.name] = (now, kind)
                return now, kind
            before = now
        raise InvalidOperation(f"{h.name}: recursion deeper than {LEVELS} levels, or without end")

    def _lookup(self, known: tuple[DataFrame, object], obj: ObjV, frame: Frame) -> V:
        """The solved value of an element, joined by its key."""
        df, kind = known
        key, name = frame.fresh("k"), frame.fresh("solved")
        frame.df = frame.df.join(df.select(F.col("key").alias(key), F.col("value").alias(name)), column(obj) == F.col(f"`{key}`"), "left").drop(key)
        return V(F.col(f"`{name}`"), kind)

    def _counted(self, h: A.Helper, args: list, env: dict, frame: Frame | None) -> V | None:
        """f(n) = if n < K then base else step(n, f(n - c)) as a fold over n's steps, without Python; None if h has another form."""
        names, body = [p.name for p in h.params or ()], h.body
        if not (isinstance(body, A.If) and isinstance(body.cond, A.Bin) and body.cond.op in ("<", "<=", "=") and isinstance(body.cond.left, A.Var) and body.cond.left.name in names):
            return None
        at, limit = names.index(body.cond.left.name), body.cond.right
        calls = {x for x in _walk(body.other) if isinstance(x, A.Call) and x.name == h.name}
        if len(calls) != 1 or any(isinstance(x, (A.Call, A.Nav)) and x.name == h.name for y in (body.then, *next(iter(calls)).args) for x in _walk(y)) or type_of(args[at]) != ty.INTEGER:
            return None
        call = next(iter(calls))
        down = call.args[at] if call.source in (None, A.Var("thisModule")) and len(call.args) == len(names) else None
        same = down is not None and all(a == A.Var(n) for i, (a, n) in enumerate(zip(call.args, names)) if i != at)
        if not (same and isinstance(down, A.Bin) and down.op == "-" and down.left == A.Var(names[at]) and isinstance(down.right, A.Lit) and type(down.right.value) is int and down.right.value > 0
                and isinstance(limit, A.Lit) and type(limit.value) is int):
            return None
        n, c, kind = column(args[at]), down.right.value, ty.parse(h.result)
        last = limit.value - (body.cond.op == "<")  # no step is left at this n or below
        steps = F.when(n > last, F.ceil((n - last) / F.lit(c)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

        def value(x: A.Expr, place: Column, acc: Column | None = None) -> Column:
            scope = dict(zip(names, args)) | {names[at]: V(place, ty.INTEGER)} | ({"$acc": V(acc, kind)} if acc is not None else {})
            return column(self.lower(x, scope, frame)).cast(ty.to_spark(kind))

        base = value(body.then, n - steps * c)
        if body.cond.op == "=":
            base = F.when(n - steps * c == last, base).otherwise(F.raise_error(F.lit(f"{h.name}: recursion without end")).cast(ty.to_spark(kind)))
        step = _swap(body.other, call, A.Var("$acc"))
        folded = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(steps, F.lit(1))), base, lambda acc, i: value(step, n - (steps - i) * c, acc))
        return V(F.when(n.isNotNull(), F.when(steps > 0, folded).otherwise(base)), kind)

    def _recursive(self, h: A.Helper, receiver, args: list) -> V:
        """A recursive helper over columns: Arrow batches through the driver's evaluator, once per different argument."""
        result = ty.parse(h.result)
        given = ([("self", receiver)] if receiver is not None and h.context else []) + list(zip([p.name for p in h.params or ()], args))
        if any(isinstance(v, (ObjV, SetV)) for _, v in given):
            raise InvalidOperation(f"recursive helper {h.name} over elements")
        names, module = [n for n, _ in given], self.module

        @F.pandas_udf(ty.to_spark(result))
        def run(*columns: pd.Series) -> pd.Series:
            evaluator, memo, out = Evaluator(module), {}, []
            for row in zip(*(c.tolist() for c in columns)):
                row = tuple(int(x) if isinstance(x, float) and x.is_integer() else x for x in row)
                if row not in memo:
                    memo[row] = evaluator.eval(h.body, dict(zip(names, row)))
                out.append(memo[row])
            return pd.Series(out, dtype=object)

        return V(run(*[column(v) for _, v in given]), result)

    # collections that are tables

    def correlate(self, s: SetV, frame: Frame) -> SetV:
        """The same collection with the parent's columns beside its own."""
        if s.correlated:
            return s
        parent = s.parent or frame
        if not parent.rowid:
            raise InvalidOperation("rows without a key in a correlated collection")
        if s.link:
            cond = reduce(lambda a, b: a & b, [parent.df[p] == s.frame.df[c] for p, c in s.link])
            df = parent.df.join(s.frame.df, cond, "inner")
        else:
            df = parent.df.crossJoin(s.frame.df)  # a following select() turns it into a join on its condition
        child = Frame(df, [*parent.rowid, *s.frame.rowid], {**parent.joined, **s.frame.joined})
        return s.but(frame=child, parent=parent, correlated=True, link=[])

    def scope(self, s: SetV, fn: A.Lambda, env: dict, frame: Frame | None) -> SetV:
        """A copy of the collection in whose rows the body can be lowered: beside the parent's columns if it reads outer variables."""
        outer = [n for n in A.free_vars(fn.body) - {fn.param} if n in env and isinstance(env[n], (V, ObjV, TupleV))]
        s = s.but(frame=s.frame.copy())
        if outer and frame is not None and frame is not s.frame:
            s = self.correlate(s, frame)
        return s

    def bind(self, s: SetV, fn: A.Lambda, env: dict, frame: Frame | None):
        """(collection, value of the body over its elements)."""
        s = self.scope(s, fn, env, frame)
        return s, self.lower(fn.body, {**env, fn.param: s.element}, s.frame)

    def attach(self, s: SetV, aggregates: dict[str, Column], frame: Frame | None) -> Frame:
        """Group the collection by the rows it belongs to and bring the aggregates back by a left join."""
        keys = s.group()
        target = s.parent or frame
        if not keys:
            total = s.frame.df.agg(*[c.alias(n) for n, c in aggregates.items()])  # one row
            if target is None:
                return Frame(total, [])
            target.df = target.df.crossJoin(F.broadcast(total))
            return target
        renamed = [target.fresh("k") for _ in keys]
        grouped = s.frame.df.groupBy(*[F.col(f"`{k}`").alias(r) for k, r in zip(keys, renamed)]).agg(*[c.alias(n) for n, c in aggregates.items()])
        own = target.rowid if s.correlated else [p for p, _ in s.link]
        cond = reduce(lambda a, b: a & b, [target.df[p] == grouped[r] for p, r in zip(own, renamed)])
        target.df = target.df.join(grouped, cond, "left").drop(*renamed)
        return target

    def compared(self, e: A.Call, env: dict, frame: Frame | None) -> V | None:
        """A count, quantifier, sum or extreme over the elements that compare with the row's own values, without pairs of rows; None for other forms.

        The form: ``all->select(x | ..)->size()`` and the like, where the conditions joined by ``and`` are each about x alone, about the row
        alone, or compare a value of x with one of the row; at most one of these by order. What a row is told is then the total of the elements with equal
        values up to its own (totals_upto); ``<>`` is all elements less the equal ones.
        """
        if frame is None or not frame.rowid or e.name not in COUNTS and e.name not in MERGE:
            return None
        counts, source, tests, made = e.name in COUNTS, e.source, [], None
        fn = e.args[0] if e.args else None
        if e.args and not (len(e.args) == 1 and isinstance(fn, A.Lambda) and e.name in ("exists", "forAll", "one")):
            return None
        if fn is not None:
            if e.name == "forAll" and not (isinstance(fn.body, A.Bin) and fn.body.op in OPPOSITE):
                return None
            tests.append(A.Lambda(fn.param, replace(fn.body, op=OPPOSITE[fn.body.op])) if e.name == "forAll" else fn)
        elif e.name == "forAll":
            return None
        elif not counts and isinstance(source, A.Call) and source.name == "collect" and len(source.args) == 1 and isinstance(source.args[0], A.Lambda):
            made, source = source.args[0], source.source
        while isinstance(source, A.Call) and source.name == "select" and len(source.args) == 1 and isinstance(source.args[0], A.Lambda):
            tests.insert(0, source.args[0])
            source = source.source
        if any(isinstance(x, (A.Call, A.Iterate)) and not (isinstance(x, A.Call) and x.name == "allInstances") for x in _walk(source)):
            return None

        def outer(x: A.Expr, param: str) -> bool:
            return any(isinstance(env.get(n), (V, ObjV, TupleV)) for n in A.free_vars(x) - {param})

        own, rows, pairs = [], [], []  # conditions of the elements, of the row, and (op, param, element's side, row's side)
        for test in tests:
            for c in _conjuncts(test.body):
                if "self" in env and any(isinstance(x, A.Call) and x.source is None for x in _walk(c)):
                    return None  # such a call may read self
                if not outer(c, test.param):
                    own.append((test.param, c))
                elif test.param not in A.free_vars(c):
                    rows.append(c)
                elif isinstance(c, A.Bin) and c.op in SWAPPED:
                    op, x, y = c.op, c.left, c.right
                    if test.param in A.free_vars(y):
                        op, x, y = SWAPPED[op], y, x
                    if outer(x, test.param) or test.param in A.free_vars(y):
                        return None
                    pairs.append((op, test.param, x, y))
                else:
                    return None
        ops = [p[0] for p in pairs]
        ordered = sum(op in ("<", ">", "<=", ">=") for op in ops)
        if not pairs or ordered > 1 or ops.count("<>") > (2 if counts else 0) or made is not None and outer(made.body, made.param):
            return None
        probe = frame.copy()
        s = self.lower(source, env, probe)
        if not isinstance(s, SetV) or isinstance(s.element, SetV) or s.correlated or s.parent not in (None, probe) or s.link and [p for p, _ in s.link] == probe.rowid:
            return None  # of the last, an element meets one row only
        child = s.frame.copy()
        scope = lambda param: {**env, param: s.element}
        for param, c in own:
            self.filter(child, c, scope(param))
        sides = []
        for op, param, x, y in pairs:
            a, b = self.held(self.lower(x, scope(param), child), child), self.held(self.lower(y, env, probe), probe)
            self.binary(op, a, b)  # checks the types
            sides.append((op, column(a), column(b)))
        sides += [("=", F.col(f"`{c}`"), F.col(f"`{p}`")) for p, c in s.link]
        where = [column(self.lower(c, env, probe)) for c in rows]
        element = s.element if made is None else self.lower(made.body, scope(made.param), child)
        if not isinstance(element, V) and not counts or not self._comparable(sides, child, probe):
            return None
        t = ty.INTEGER if counts else type_of(element)
        how, x = ("sum", F.lit(1).cast("bigint")) if counts else (e.name, column(element))
        frame.df, frame.joined = probe.df, probe.joined
        spread = not s.link
        asking = reduce(lambda df, c: df.where(c), where, frame.df)
        names, ids = [f"k{i}" for i, _ in enumerate(sides)], [f"id{i}" for i, _ in enumerate(frame.rowid)]
        tie = child.rowid or [f.name for f in child.df.schema if isinstance(f.dataType, AtomicType)]
        known = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])  # NaN stays: it is the greatest number
        given = child.df.select(*[c.alias(n) for (_, c, _), n in zip(sides, names)], x.alias("x"), F.xxhash64(*[F.col(f"`{n}`") for n in tie]).alias("tie")).where(known)
        asking = asking.select(*[c.alias(n) for (_, _, c), n in zip(sides, names)], *[F.col(f"`{r}`").alias(i) for r, i in zip(frame.rowid, ids)]).where(known).withColumn("tie", F.xxhash64(*ids))
        by = {n: op for (op, _, _), n in zip(sides, names)}
        n = self._totals(asking, given, by, how, ids, spread)
        renamed = {i: frame.fresh("k") for i in ids} | {"total": frame.fresh("agg")}
        n = n.select(*[F.col(i).alias(r) for i, r in renamed.items()])
        cond = reduce(lambda a, b: a & b, [frame.df[r] == n[renamed[i]] for r, i in zip(frame.rowid, ids)])
        frame.df = frame.df.join(n, cond, "left").drop(*[renamed[i] for i in ids])
        total = F.col(f"`{renamed['total']}`")
        if counts:
            v = COUNTS[e.name](F.coalesce(total, F.lit(0).cast("bigint")))
            return V(v, ty.INTEGER if e.name in ("size", "count") else ty.BOOLEAN)
        if e.name != "sum":
            return V(total, t)
        return V(F.coalesce(total, F.lit(0.0) if t == ty.REAL else F.lit(0).cast("bigint")), t)

    def _totals(self, asking: DataFrame, given: DataFrame, by: dict[str, str], how: str, ids: list[str], spread: bool) -> DataFrame:
        """(ids, total) of the rows that have one: columns ``by`` (name to comparison) of both sides."""
        fn = MERGE[how][0]
        groups, unequal = ([n for n, op in by.items() if op == wanted] for wanted in ("=", "<>"))
        last = next((n for n, op in by.items() if op not in ("=", "<>")), None)
        if unequal and (spread or not last or len(unequal) > 1):
            every = self._totals(asking, given, {n: op for n, op in by.items() if n != unequal[0]}, how, ids, spread)
            same = self._totals(asking, given, {**by, unequal[0]: "="}, how, ids, spread)
            return every.unionByName(same.withColumn("total", -F.col("total"))).groupBy(*ids).agg(fn("total").alias("total"))
        if last:
            kept = [*groups, *unequal, F.col(last).alias("v"), "tie"]
            out = totals_upto(asking.select(*kept, *ids), given.select(*kept, "x"), groups, how, by[last], spread, less=tuple(unequal))
        elif groups:
            out = asking.join(given.groupBy(*groups).agg(fn("x").alias("total")), groups)
        else:
            out = asking.crossJoin(F.broadcast(given.agg(fn("x").alias("total"))))
        return out.groupBy(*ids).agg(fn("total").alias("total"))  # rows of one key are one row

    def _comparable(self, sides: list[tuple[str, Column, Column]], child: Frame, parent: Frame) -> bool:
        """Whether a union of the two sides' columns has the values that their comparison has."""
        a, b = ([f.dataType for f in df.select(*[c.alias(f"c{i}") for i, c in enumerate(cs)]).schema] for df, cs in ((child.df, [x for _, x, _ in sides]), (parent.df, [y for _, _, y in sides])))
        numbers = lambda t: isinstance(t, NumericType)
        return all(numbers(x) and numbers(y) or x == y and isinstance(x, AtomicType) for x, y in zip(a, b))

    def aggregate(self, s: SetV, expr: Column, t, default, frame: Frame | None) -> V:
        target = s.parent or frame
        name = target.fresh("agg") if target is not None else "value"
        made = self.attach(s, {name: expr}, frame)
        c = F.col(f"`{name}`")
        out = V(c if default is None else F.coalesce(c, default), t)
        if target is None:
            out.frame = made  # a query's own row
        return out

    def set_call(self, s: SetV, name: str, args: tuple, env: dict, frame: Frame | None):
        fn = args[0] if args and isinstance(args[0], A.Lambda) else None
        if name == "select" and fn:
            s = self.scope(s, fn, env, frame)
            self.filter(s.frame, fn.body, {**env, fn.param: s.element})
            return s
        if name == "reject" and fn:
            s, v = self.bind(s, fn, env, frame)
            s.frame.df = s.frame.df.where(~column(v))
            return s
        if name == "collect" and fn:
            s, v = self.bind(s, fn, env, frame)
            if isinstance(v, V):
                s.frame.df = s.frame.df.where(column(v).isNotNull())
            return s.but(element=v, kind="Sequence" if s.kind in ("Sequence", "OrderedSet") else "Bag")
        if name == "sortedBy" and fn:
            s, v = self.bind(s, fn, env, frame)
            return s.but(order=[column(v), *s.order], kind="Sequence")
        if name in ("exists", "forAll", "one", "any", "isUnique") and fn:
            s, v = self.bind(s, fn, env, frame)
            p = column(v)
            if name == "exists":
                return self.aggregate(s, F.bool_or(p), ty.BOOLEAN, F.lit(False), frame)
            if name == "forAll":
                return self.aggregate(s, F.bool_and(p), ty.BOOLEAN, F.lit(True), frame)
            if name == "one":
                return self.aggregate(s, F.count_if(p) == 1, ty.BOOLEAN, F.lit(False), frame)
            if name == "isUnique":
                return self.aggregate(s, F.count(F.lit(1)) == F.count_distinct(F.struct(p)), ty.BOOLEAN, F.lit(True), frame)
            s.frame.df = s.frame.df.where(p)
            return self.pick(s, True, frame)
        if name in ("size", "count") and not args:
            return self.aggregate(s, F.count(F.lit(1)), ty.INTEGER, F.lit(0), frame)
        if name in ("isEmpty", "notEmpty", "exists"):
            n = self.aggregate(s, F.count(F.lit(1)), ty.INTEGER, F.lit(0), frame)
            out = V(column(n) == 0 if name == "isEmpty" else column(n) > 0, ty.BOOLEAN)
            if hasattr(n, "frame"):
                out.frame = n.frame
            return out
        if name in ("first", "any"):
            return self.pick(s, True, frame)
        if name == "last":
            return self.pick(s, False, frame)
        if name == "at":
            n = self.lower(args[0], env, frame)
            if not s.group() and isinstance(args[0], A.Lit):
                return self.pick(self.ranked(self.head(s, args[0].value), lambda r: r == column(n)), True, frame)
            return self.pick(self.ranked(s, lambda r: r == column(n)), True, frame)
        if name in ("sum", "max", "min", "avg"):
            t, c = type_of(s.element), column(s.element)
            if name == "sum" and t == ty.REAL:
                return self.aggregate(s, F.sum(c), t, F.lit(0.0), frame)
            expr = {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg}[name](c)
            return self.aggregate(s, expr, ty.REAL if name == "avg" else t, F.lit(0).cast("bigint") if name == "sum" else None, frame)
        if name == "count":
            other = self.lower(args[0], env, frame)
            s = self.correlate(s, frame) if frame is not None and not s.correlated else s
            return self.aggregate(s, F.count_if(column(s.element) == column(other)), ty.INTEGER, F.lit(0), frame)
        if name in ("includes", "excludes"):
            return self.membership(s, self.lower(args[0], env, frame), name == "includes", frame)
        if name == "indexOf":
            return self.index_of(s, self.lower(args[0], env, frame), frame)
        if name in ("subSequence", "subOrderedSet"):
            lo, hi = (column(self.lower(a, env, frame)) for a in args)
            if not s.group() and isinstance(args[1], A.Lit):
                s = self.head(s, args[1].value)
                if isinstance(args[0], A.Lit) and args[0].value == 1:
                    return s
            return self.ranked(s, lambda r: r.between(lo, hi))
        if name in ("asSequence", "asBag"):
            return s.but(kind=name[2:])
        if name in ("asSet", "asOrderedSet"):
            return self.distinct(s, name[2:])
        if name == "flatten":
            return self.flatten(s)
        if name in ("union", "intersection", "difference", "symmetricDifference", "including", "excluding"):
            return self.combine(s, name, self.lower(args[0], env, frame), frame)
        if name in ("includesAll", "excludesAll"):
            return self.contains_all(s, self.lower(args[0], env, frame), name == "includesAll", frame)
        if name == "oclIsUndefined":
            return literal(False)
        if fn is None and name in ("select", "reject", "collect"):
            return s
        h = self._find(name, None)
        if h is not None:
            return self.helper(name, s, [self.lower(a, env, frame) for a in args], env, frame)
        raise UnknownOperation(f"{s.kind}.{name}")

    def head(self, s: SetV, n: int) -> SetV:
        """The first n elements by the collection's order."""
        f = s.frame.copy()
        f.df = f.df.orderBy(*s.order).limit(max(0, n))
        return s.but(frame=f)

    def pick(self, s: SetV, first: bool, frame: Frame | None):
        """The first or last element by the collection's order; null if there is none."""
        keys = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(s.order)]) if s.order else F.lit(1)
        by = F.min_by if first else F.max_by
        e = s.element
        if isinstance(e, ObjV):
            if e.key is None:
                raise InvalidOperation(f"{e.cls} has no key")
            v = self.aggregate(s, by(e.key, keys), ty.ANY, None, frame)
            target = s.parent or frame or v.frame
            got = ObjV(target.fresh("pick"), e.cls, e.alias, column(v), loaded=False)
            if s.parent is None and frame is None:
                got.frame = v.frame
            return got
        return self.aggregate(s, by(column(e), keys), type_of(e), None, frame)

    def ranked(self, s: SetV, keep) -> SetV:
        f = s.frame.copy()
        name = f.fresh("rank")
        f.df = self.numbered(f.df, s, name).where(keep(F.col(f"`{name}`"))).drop(name)
        return s.but(frame=f)

    def numbered(self, df: DataFrame, s: SetV, name: str) -> DataFrame:
        """df with the 1-based place of each element in its collection."""
        if not s.group():
            return global_rank(df, s.order, name)
        w = Window.partitionBy(*[F.col(f"`{k}`") for k in s.group()]).orderBy(*s.order)
        return df.withColumn(name, F.row_number().over(w).cast("bigint"))

    def index_of(self, s: SetV, v, frame: Frame | None) -> V:
        """1-based place; 0 if absent."""
        f = s.frame.copy()
        name = f.fresh("place")
        target = s.parent or frame
        at, link = target.fresh("item"), [target.fresh("k") for _ in s.group()]
        places = self.numbered(f.df, s, name).select(*[F.col(f"`{k}`").alias(r) for k, r in zip(s.group(), link)], column(s.element).alias(at), name)
        if type_of(s.element) is not None and not isinstance(s.element, ObjV):
            places = places.groupBy(*link, at).agg(F.min(name).alias(name))
        own = target.rowid if s.correlated else [p for p, _ in s.link]
        cond = reduce(lambda a, b: a & b, [target.df[p] == places[r] for p, r in zip(own, link)], column(v) == places[at])
        target.df = target.df.join(places, cond, "left").drop(*link, at)
        return V(F.coalesce(F.col(f"`{name}`"), F.lit(0)), ty.INTEGER)

    def membership(self, s: SetV, v, positive: bool, frame: Frame | None) -> V:
        target = s.parent or frame
        if target is None:
            found = self.aggregate(s, F.bool_or(column(s.element) == column(v)), ty.BOOLEAN, F.lit(False), frame)
            out = V(column(found) if positive else ~column(found), ty.BOOLEAN)
            out.frame = found.frame
            return out
        item, mark, link = target.fresh("item"), target.fresh("in"), [target.fresh("k") for _ in s.group()]
        members = s.frame.df.select(*[F.col(f"`{k}`").alias(r) for k, r in zip(s.group(), link)], column(s.element).alias(item)).distinct().withColumn(mark, F.lit(True))
        own = target.rowid if s.correlated else [p for p, _ in s.link]
        cond = reduce(lambda a, b: a & b, [target.df[p] == members[r] for p, r in zip(own, link)], column(v) == members[item])
        target.df = target.df.join(members, cond, "left").drop(item, *link)
        c = F.coalesce(F.col(f"`{mark}`"), F.lit(False))
        return V(c if positive else ~c, ty.BOOLEAN)

    def distinct(self, s: SetV, kind: str) -> SetV:
        f = s.frame.copy()
        keys = s.group()
        if isinstance(s.element, ObjV):
            columns = [*keys, f"{s.element.prefix}__{self.models[s.element.alias].metamodel.key(s.element.cls)}"]
            f.df = f.df.dropDuplicates(columns)
            return s.but(frame=f, kind=kind)
        name = f.fresh("value")
        least = f.fresh("order")
        plain = [c.alias(f"o{i}") for i, c in enumerate(s.order)]
        rows = f.df.select(*[F.col(f"`{k}`") for k in keys], column(s.element).alias(name), F.struct(*plain).alias(least) if plain else F.lit(1).alias(least))
        if kind == "OrderedSet":
            f.df, order = rows.groupBy(*keys, name).agg(F.min(least).alias(least)), [F.col(f"`{least}`")]
        else:
            f.df, order = rows.select(*keys, name).distinct(), [F.col(f"`{name}`")]
        f.rowid = []
        e = TupleV({n: V(F.col(f"`{name}`").getField(n), type_of(x)) for n, x in s.element.fields.items()}) if isinstance(s.element, TupleV) else V(F.col(f"`{name}`"), type_of(s.element))
        return s.but(frame=f, element=e, kind=kind, order=order)

    def flatten(self, s: SetV) -> SetV:
        inner = s.element
        if isinstance(inner, SetV):
            if inner.correlated:
                f = inner.frame
            else:
                cond = reduce(lambda a, b: a & b, [s.frame.df[p] == inner.frame.df[c] for p, c in inner.link])
                f = Frame(s.frame.df.join(inner.frame.df, cond, "inner"), [*s.frame.rowid, *inner.frame.rowid])
            return s.but(frame=f, element=inner.element, order=[*s.order, *inner.order], kind="Bag")
        if isinstance(type_of(inner), ty.CollType):
            f = s.frame.copy()
            name, place = f.fresh("item"), f.fresh("at")
            f.df = f.df.select("*", F.posexplode(column(inner)).alias(place, name))
            return s.but(frame=f, element=V(F.col(f"`{name}`"), type_of(inner).element), order=[*s.order, F.col(f"`{place}`")])
        return s

    def _sides(self, s: SetV, other, frame: Frame | None) -> tuple[list[str], Frame | None, list[str], DataFrame, DataFrame]:
        """Two collections as rows: (keys of the parent's rows, the parent, the key columns' names, left, right).

        The rows have the keys (none for collections of their own), ``item`` and ``o``: the place
        in an ordered left side, else 0. ``other`` is a collection of rows, an array or an element.
        """
        parent = s.parent or frame
        if not s.group():
            if isinstance(other, SetV) and other.group():
                raise InvalidOperation("a collection of one row combined with one of all rows")
            keys: list[str] = []
        else:
            keys = list(parent.rowid) if s.correlated else [p for p, _ in s.link]
            shared = isinstance(other, SetV) and not s.correlated and not other.correlated and [p for p, _ in other.link] == keys
            if not shared and keys != parent.rowid:
                s, keys = self.correlate(s, parent), list(parent.rowid)
        names = [parent.fresh(f"m{i}") for i, _ in enumerate(keys)] if keys else []

        def rows(c: SetV) -> DataFrame:
            df, place = c.frame.df, F.lit(0).cast("bigint").alias("o")
            if keys and c.kind in ("Sequence", "OrderedSet") and c.order:
                df, place = self.numbered(df, c, "$place"), F.col("`$place`").alias("o")
            return df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(c.group(), names)], column(c.element).alias("item"), place)

        if isinstance(other, SetV):
            if keys and not other.group():
                raise InvalidOperation("a collection of all rows combined with those of one row")
            if keys and (list(parent.rowid) if other.correlated else [p for p, _ in other.link]) != keys:
                other = self.correlate(other, parent)
            right = rows(other)
        else:
            base = parent.df if keys else s.frame.df.sparkSession.range(1)
            c = column(other)
            items = F.explode(c) if isinstance(type_of(other), ty.CollType) else c
            right = base.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], items.alias("item")).withColumn("o", F.lit(0).cast("bigint"))
        return keys, parent if keys else None, names, rows(s), right

    def combine(self, s: SetV, name: str, other, frame: Frame | None) -> SetV:
        """Set operations, of whole collections or for each parent: one exchange by parent and element."""
        sets = s.kind in ("Set", "OrderedSet") and (type_of(other).kind in ("Set", "OrderedSet") if isinstance(type_of(other), ty.CollType) else True)
        keys, parent, names, left, right = self._sides(s, other, frame)
        both = [*names, "item"]
        if name in ("union", "including"):
            df = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
        elif name == "symmetricDifference":
            only = lambda a, b: a.join(b.select(*both).distinct(), both, "left_anti")
            df = only(left, right).withColumn("side", F.lit(0)).unionByName(only(right, left).withColumn("side", F.lit(1)))
            sets = True
        else:
            kept = "left_semi" if name == "intersection" else "left_anti"
            df = left.join(right.select(*both).distinct(), both, kept).withColumn("side", F.lit(0))
        order = F.struct("side", "o")
        ordered = bool(keys) and s.kind in ("Sequence", "OrderedSet")
        df = df.groupBy(*both).agg(F.min(order).alias("o")) if sets else df.select(*both, order.alias("o"))
        prefix = self._prefix("both")
        columns = {n: f"{prefix}$k{i}" for i, n in enumerate(names)} | {"item": f"{prefix}$item", "o": f"{prefix}$o"}
        df = df.select(*[F.col(f"`{n}`").alias(c) for n, c in columns.items()])
        item = F.col(f"`{prefix}$item`")
        made = Frame(df, [*(columns[n] for n in names), f"{prefix}$item"] if sets else [])
        link = [(k, columns[n]) for k, n in zip(keys, names)]
        if isinstance(s.element, ObjV):
            element = ObjV(f"{prefix}e", s.element.cls, s.element.alias, item, loaded=False)
        elif isinstance(s.element, TupleV):
            element = TupleV({n: V(item.getField(n), type_of(x)) for n, x in s.element.fields.items()})
        else:
            element = V(item, type_of(s.element))
        kind = s.kind if sets or ordered else "Bag"
        return SetV(made, element, kind, parent, link, order=[F.col(f"`{prefix}$o`"), item] if ordered else [item])

    def contains_all(self, s: SetV, other, positive: bool, frame: Frame | None) -> V:
        """includesAll and excludesAll: no element of ``other`` is missing, or found."""
        keys, parent, names, left, right = self._sides(s, other, frame)
        both = [*names, "item"]
        against = right.join(left.select(*both).distinct(), both, "left_anti" if positive else "left_semi")
        prefix = self._prefix("all")
        against = against.select(*[F.col(f"`{n}`").alias(f"{prefix}$k{i}") for i, n in enumerate(names)])
        link = [(k, f"{prefix}$k{i}") for i, k in enumerate(keys)]
        n = self.aggregate(SetV(Frame(against, []), V(F.lit(1), ty.INTEGER), "Bag", parent, link), F.count(F.lit(1)), ty.INTEGER, F.lit(0), frame)
        return self._with(n, V(column(n) == 0, ty.BOOLEAN))

    # folds

    def iterate(self, e: A.Iterate, env: dict, frame: Frame | None):
        v = self.lower(e.source, env, frame)
        init = self.lower(e.init, env, frame)
        if not isinstance(v, SetV):
            t = type_of(v)
            if not isinstance(t, ty.CollType):
                raise TypeMismatch(f"iterate over {t}")
            start = ty.parse(e.acc_type) if e.acc_type and type_of(init) in (ty.ANY, ty.VOID) else type_of(init)

            def body(acc, x, kind):
                out = self.lower(e.body, {**env, e.var: V(x, t.element), e.acc: V(acc, kind)}, frame)
                return column(out), type_of(out)

            return V(*fc.fold(column(v), column(init), start, body))
        known = self.monoid(e, v, init, env, frame)
        return known if known is not None else self.ordered_fold(e, v, init, env, frame)

    def monoid(self, e: A.Iterate, s: SetV, init, env: dict, frame: Frame | None):
        """Folds that are sums, counts, extremes or quantifiers become plain aggregates."""
        acc = A.Var(e.acc)

        def value(x: A.Expr):
            if e.acc in A.free_vars(x):
                return None
            return self.bind(s, A.Lambda(e.var, x), env, frame)

        body = e.body
        plus = None
        if isinstance(body, A.Bin) and body.op in ("+", "*", "and", "or") and body.left == acc:
            plus = value(body.right)
        elif isinstance(body, A.Bin) and body.op in ("+", "*", "and", "or") and body.right == acc and body.op != "+":
            plus = value(body.left)
        if plus is not None:
            made, v = plus
            t, c = type_of(v), column(v)
            if body.op == "+" and t in (ty.INTEGER, ty.REAL) and type_of(init) in (ty.INTEGER, ty.REAL):
                total = self.aggregate(made, F.sum(c), t, F.lit(0).cast("bigint") if t == ty.INTEGER else F.lit(0.0), frame)
                return self._with(total, V(column(init) + column(total), ty.join(t, type_of(init))))
            if body.op in ("and", "or"):
                both = self.aggregate(made, (F.bool_and if body.op == "and" else F.bool_or)(c), ty.BOOLEAN, F.lit(body.op == "and"), frame)
                return self._with(both, V(column(init) & column(both) if body.op == "and" else column(init) | column(both), ty.BOOLEAN))
            return None
        if isinstance(body, A.If):
            if body.other == acc and isinstance(body.then, A.Bin) and body.then.op == "+" and body.then.left == acc and e.acc not in A.free_vars(body.cond):
                step = A.If(body.cond, body.then.right, A.Lit(0, "Integer"))
                return self.monoid(A.Iterate(e.source, e.var, e.acc, e.acc_type, e.init, A.Bin("+", acc, step)), s, init, env, frame)
            c = body.cond
            if body.other == acc and isinstance(c, A.Bin) and c.op in (">", "<"):
                if body.then == c.left and c.right == acc and (got := value(body.then)):
                    made, v = got
                    if isinstance(v, V) and type_of(v) in (ty.INTEGER, ty.REAL, ty.STRING):
                        most = self.aggregate(made, (F.max if c.op == ">" else F.min)(column(v)), type_of(v), None, frame)
                        pick = F.greatest if c.op == ">" else F.least
                        return self._with(most, V(pick(column(init), column(most)), type_of(v)))
                if body.then == A.Var(e.var) and isinstance(c.left, A.Nav) and c.left.source == A.Var(e.var) and c.right == A.Nav(acc, c.left.name) and isinstance(e.init, A.Call) and e.init.name == "first" and e.init.source == e.source:
                    made, v = value(c.left)  # arg max or min: of equals the first in order
                    sign = -column(v) if c.op == ">" else column(v)
                    return self.pick(made.but(order=[sign, *made.order]), True, frame)
        return None

    def _with(self, source, v: V) -> V:
        if hasattr(source, "frame"):
            v.frame = source.frame
        return v

    def ordered_fold(self, e: A.Iterate, s: SetV, init, env: dict, frame: Frame | None):
        """Any other fold: the elements' features in order as an array per row, folded by a higher-order function."""
        names = sorted({x.name for x in _walk(e.body) if isinstance(x, A.Nav) and x.source == A.Var(e.var)})
        f = s.but(frame=s.frame.copy())
        if isinstance(s.element, ObjV):
            fields = {n: self.navigate(s.element, n, f.frame, env) for n in names}
            item = TupleV(fields)
        else:
            item = s.element
        order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(s.order)]) if s.order else F.lit(1)
        packed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), column(item).alias("x")))), lambda p: p["x"])
        target = s.parent or frame
        name = target.fresh("list") if target is not None else "list"
        made = self.attach(f, {name: packed}, frame)
        element = type_of(item)

        def body(acc, x, kind):
            out = self.lower(e.body, {**env, e.var: V(x, element), e.acc: V(acc, kind)}, target)
            return column(out), type_of(out)

        listed = F.coalesce(F.col(f"`{name}`"), F.array().cast(f"array<{ty.to_spark(element)}>"))
        out = V(*fc.fold(listed, column(init), type_of(init), body))
        if target is None:
            out.frame = made
        return out

    # filters

    def filter(self, frame: Frame, e: A.Expr, env: dict) -> None:
        """Keep the rows for which e is true; quantifiers over to-many references become semi and anti joins."""
        if isinstance(e, A.Bin) and e.op == "and":
            self.filter(frame, e.left, env)
            self.filter(frame, e.right, env)
            return
        positive, inner = True, e
        while isinstance(inner, A.Un) and inner.op == "not":
            positive, inner = not positive, inner.operand
        if isinstance(inner, A.Call) and inner.source is not None and inner.name in ("exists", "forAll", "isEmpty", "notEmpty") and not self.constant(inner):
            probe = frame.copy()
            s = self.lower(inner.source, env, probe)
            if isinstance(s, SetV) and s.link and not s.correlated:
                fn = inner.args[0] if inner.args else None
                made = s
                if fn is not None:
                    s = s.but(parent=probe)
                    made, v = self.bind(s, fn, env, probe)
                    p = column(v)
                    made.frame.df = made.frame.df.where(p if inner.name == "exists" else ~p)
                if not made.correlated:
                    has = inner.name in ("exists", "notEmpty")
                    frame.df, frame.joined = probe.df, probe.joined
                    right = made.frame.df.select(*[F.col(f"`{c}`").alias(f"$r{i}") for i, (_, c) in enumerate(made.link)])
                    cond = reduce(lambda a, b: a & b, [frame.df[p] == right[f"$r{i}"] for i, (p, _) in enumerate(made.link)])
                    frame.df = frame.df.join(right, cond, "left_semi" if has == positive else "left_anti")
                    return
        if isinstance(inner, A.Call) and inner.source is not None and inner.name in ("includes", "excludes") and len(inner.args) == 1 and not self.constant(inner):
            probe = frame.copy()
            s = self.lower(inner.source, env, probe)
            if isinstance(s, SetV) and not s.correlated and s.parent in (None, probe):
                item = column(self.lower(inner.args[0], env, probe))
                right = s.frame.df.select(*[F.col(f"`{c}`").alias(f"$r{i}") for i, (_, c) in enumerate(s.link)], column(s.element).alias("$item"))
                cond = reduce(lambda a, b: a & b, [probe.df[p] == right[f"$r{i}"] for i, (p, _) in enumerate(s.link)], item == right["$item"])
                frame.df, frame.joined = probe.df.join(right, cond, "left_semi" if (inner.name == "includes") == positive else "left_anti"), probe.joined
                return
        kept = column(self.lower(e, env, frame))  # may add joins to the frame
        frame.df = frame.df.where(kept)


def _swap(e, old: A.Expr, new: A.Expr):
    """e with ``old`` replaced everywhere."""
    if e == old:
        return new
    if isinstance(e, tuple):
        return tuple(_swap(x, old, new) for x in e)
    if isinstance(e, A.Expr):
        return replace(e, **{f.name: _swap(getattr(e, f.name), old, new) for f in fields(e)})
    return e


def _conjuncts(e: A.Expr) -> list[A.Expr]:
    return [*_conjuncts(e.left), *_conjuncts(e.right)] if isinstance(e, A.Bin) and e.op == "and" else [e]


def _walk(e: A.Expr):
    yield e
    for x in A.children(e):
        yield from _walk(x)
