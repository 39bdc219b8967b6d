"""Rules as plans: guards are filters, target patterns projections, references deterministic ids.

The id of a target is rule#pattern#Class:key, a pure function of the source row. So
references between targets of a rule need no join, forward references and references
across rules need only the trace (who exists), and a retried task makes the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphspark import types as ty
from morphspark.errors import InvalidOperation, UnknownFeature
from morphspark.lang import ast as A
from morphspark.metamodel import Model
from morphspark.plans.compiler import Compiler, packed
from morphspark.plans.values import Frame, ObjV, SetV, V, column, type_of

TRACE = "rule string, source_class string, source_id string, pattern_var string, target_class string, target_id string"


class RuleSet:
    def __init__(self, module: A.Module, models: dict[str, Model], targets: dict[str, Model], registered: dict | None = None, strict: bool = False):
        """strict: a reference to an element that no rule matched is an error (of the job that reads it), not null."""
        self.module, self.models, self.targets, self.strict = module, models, targets, strict
        self.compiler = Compiler(module, models, registered, self)
        self.requests: dict[str, list[tuple[DataFrame, list]]] = {}
        self._trace: DataFrame | None = None
        #: For each rule run, all its targets together.
        self.wide: list[DataFrame] = []

    def named(self, name: str) -> A.Rule | None:
        return next((r for r in self.module.rules if r.name == name and r.kind != "matched"), None)

    # sources

    def frame(self, rule: A.Rule) -> tuple[Frame, dict]:
        """Rows and variables that a matched rule fires for: its sources' product (an equi-join if its guards say so)."""
        frame, env = None, {}
        for p in rule.sources:
            alias, cls = self.compiler.class_type(p.type)
            own, obj = self.compiler.scan(alias, cls, p.var)
            env[p.var] = obj
            frame = own if frame is None else Frame(frame.df.crossJoin(own.df), [*frame.rowid, *own.rowid])
        for p in rule.sources:
            if p.guard is not None:
                self.compiler.filter(frame, p.guard, env)
        for name, _, init in rule.using:
            env[name] = self.compiler.lower(init, env, frame)
        return frame, env

    def source_id(self, rule: A.Rule, env: dict) -> Column:
        ids = []
        for p in rule.sources:
            v = env[p.var]
            ids.append(F.concat(F.col(f"{v.prefix}___class"), F.lit(":"), column(v).cast("string")))
        return F.concat_ws("&", *ids)

    @staticmethod
    def target_id(rule: str, var: str, source: Column) -> Column:
        return F.concat(F.lit(f"{rule}#{var}#"), source)

    def trace(self) -> DataFrame:
        """A row for each target of each match of a matched rule, in declaration order of rules."""
        if self._trace is None:
            parts = []
            for rule in self.module.rules:
                if rule.kind != "matched":
                    continue
                frame, env = self.frame(rule)
                source = self.source_id(rule, env)
                cls = F.col(f"{rule.sources[0].var}___class")
                links = [F.struct(F.lit(t.var).alias("pattern_var"), F.lit(t.type.split("!")[-1]).alias("target_class"), self.target_id(rule.name, t.var, source).alias("target_id")) for t in rule.targets]
                made = frame.df.select(F.lit(rule.name).alias("rule"), cls.alias("source_class"), source.alias("source_id"), F.explode(F.array(*links)).alias("link"))  # one scan for all targets
                parts.append(made.select("rule", "source_class", "source_id", "link.*"))
            spark = next(iter(next(iter(self.models.values())).tables.values())).sparkSession
            self._trace = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], TRACE)
        return self._trace

    # references

    def _candidates(self, cls: str, alias: str, var: str | None) -> list[tuple[A.Rule, A.TargetPattern]]:
        """Rules over a class (or a relative of it) and the pattern that resolves it, in declaration order."""
        mm, out = self.models[alias].metamodel, []
        for rule in self.module.rules:
            if rule.kind != "matched" or len(rule.sources) != 1:
                continue
            a, c = self.compiler.class_type(rule.sources[0].type)
            if a == alias and (c in mm.lineage(cls) or cls in mm.lineage(c)):
                patterns = [t for t in rule.targets if var is None or t.var == var]
                if patterns:
                    out.append((rule, patterns[0]))
        return out

    def resolve(self, v, var: str | None, compiler: Compiler, frame: Frame) -> V:
        """The id of the target made for a source element, null if no rule matched it; the first rule that did wins."""
        if isinstance(v, SetV):
            element = self.resolve(v.element, var, compiler, v.frame)
            return compiler.aggregate(v, packed(element.col, v.order if v.kind in ("Sequence", "OrderedSet") else []), ty.CollType("Sequence", ty.STRING), F.array().cast("array<string>"), frame)
        if not isinstance(v, ObjV):
            raise InvalidOperation("resolveTemp takes a source element")
        found = None
        for rule, pattern in self._candidates(v.cls, v.alias, var):
            own, env = self.frame(rule)
            hit = frame.fresh("hit")
            key = frame.fresh("k")
            made = own.df.select(column(env[rule.sources[0].var]).alias(key), self.target_id(rule.name, pattern.var, self.source_id(rule, env)).alias(hit))
            frame.df = frame.df.join(made, v.key == made[key], "left").drop(key)
            found = F.col(f"`{hit}`") if found is None else F.coalesce(found, F.col(f"`{hit}`"))
        found = F.lit(None).cast("string") if found is None else found
        if self.strict:
            text = F.concat(F.lit(f"no target for {v.cls}:"), v.key.cast("string"))
            found = F.when(v.key.isNotNull() & found.isNull(), F.raise_error(text).cast("string")).otherwise(found)
        return V(found, ty.STRING)

    def invoke(self, rule: A.Rule, args: list, compiler: Compiler, frame: Frame) -> V:
        """A lazy or called rule in an expression: the id of its first target, once per different argument."""
        parts = []
        for a in args:
            if isinstance(a, ObjV):
                parts.append(F.concat(F.lit(f"{a.cls}:"), column(a).cast("string")))
            else:
                parts.append(column(a).cast("string"))
        wanted = F.concat_ws("&", *parts)
        self.requests.setdefault(rule.name, []).append((frame, [column(a) for a in args], args))
        return V(F.when(reduce(lambda x, y: x & y, [column(a).isNotNull() for a in args]), self.target_id(rule.name, rule.targets[0].var, wanted)), ty.STRING)

    # targets

    def value(self, v, frame: Frame, compiler: Compiler) -> Column:
        """What a binding stores: a source element becomes the id of its target."""
        if isinstance(v, ObjV):
            return self.resolve(v, None, compiler, frame).col
        if isinstance(v, SetV):
            if isinstance(v.element, ObjV):
                return self.resolve(v, None, compiler, frame).col
            c = column(v.element)
            t = ty.CollType(v.kind, type_of(v.element))
            return compiler.aggregate(v, packed(c, v.order), t, F.array().cast(ty.to_spark(t)), frame).col
        return column(v)

    def project(self, rule: A.Rule, frame: Frame, env: dict, source: Column) -> list[tuple[str, str, DataFrame]]:
        """(alias, class, rows) of each target pattern."""
        ids = {t.var: self.target_id(rule.name, t.var, source) for t in rule.targets}
        scope = {**env, **{n: V(c, ty.STRING) for n, c in ids.items()}}
        made = []
        for t in rule.targets:
            alias, _, cls = t.type.rpartition("!")
            self._check(alias, cls, t)
            columns = [(b.feature, self.value(self.compiler.lower(b.value, scope, frame), frame, self.compiler)) for b in t.bindings]
            made.append((alias, cls, t.var, columns))
        parts = [(alias, cls, frame.df.select(ids[var].alias("_id"), F.lit(cls).alias("_class"), *[c.alias(n) for n, c in columns])) for alias, cls, var, columns in made]
        self.wide.append(self._together(frame, [(alias, cls, ids[var], columns, df) for (alias, cls, var, columns), (_, _, df) in zip(made, parts)]))
        return parts

    def _together(self, frame: Frame, targets: list) -> DataFrame:
        """All targets of a rule from one scan of its source: _model, _class, _id and every feature, null where a class lacks it.

        A feature whose type differs between the rule's classes is text.
        """
        types: dict[str, set[str]] = {}
        for _, _, _, columns, df in targets:
            for n, _ in columns:
                types.setdefault(n, set()).add(df.schema[n].dataType.simpleString())
        kinds = {n: next(iter(t)) if len(t) == 1 else "string" for n, t in types.items()}
        rows = []
        for alias, cls, key, columns, _ in targets:
            has = dict(columns)
            rows.append(F.struct(F.lit(alias).alias("_model"), F.lit(cls).alias("_class"), key.alias("_id"), *[(has[n] if n in has else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()]))
        return frame.df.select(F.inline(F.array(*rows)))

    def _check(self, alias: str, cls: str, t: A.TargetPattern) -> None:
        model = next((m for a, m in self.targets.items() if alias in (a, m.metamodel.name)), None)
        if model is None or not model.metamodel.classes:
            return
        for b in t.bindings:
            if model.metamodel.feature(cls, b.feature) is None:
                raise UnknownFeature(f"{alias}!{cls}.{b.feature}")

    def run_matched(self, rule: A.Rule) -> list[tuple[str, str, DataFrame]]:
        frame, env = self.frame(rule)
        return self.project(rule, frame, env, self.source_id(rule, env))

    def run_requested(self, rule: A.Rule) -> list[tuple[str, str, DataFrame]]:
        """Targets of a lazy or called rule, once per different argument that expressions asked for."""
        asked, alias, names = None, None, [p.var for p in rule.sources] or [p.name for p in rule.params]
        kinds: list = []
        for frame, columns, args in self.requests.get(rule.name, []):
            rows = frame.df.select(*[c.alias(n) for n, c in zip(names, columns)]).where(reduce(lambda x, y: x & y, [F.col(n).isNotNull() for n in names]))
            asked = rows if asked is None else asked.unionByName(rows)
            kinds = args
        if asked is None:
            return []
        asked = asked.distinct()
        return self._instantiate(rule, asked, kinds, names, alias)

    def _instantiate(self, rule: A.Rule, asked: DataFrame, kinds: list, names: list[str], alias=None) -> list[tuple[str, str, DataFrame]]:
        frame, env, parts = Frame(asked, list(names)), {}, []
        for n, a in zip(names, kinds):
            if isinstance(a, ObjV):
                env[n] = ObjV(f"{n}$e", a.cls, a.alias, F.col(n), loaded=False)
                parts.append(F.concat(F.lit(f"{a.cls}:"), F.col(n).cast("string")))
            else:
                env[n] = V(F.col(n), type_of(a))
                parts.append(F.col(n).cast("string"))
        return self.project(rule, frame, env, F.concat_ws("&", *parts))

    def call(self, name: str, arguments: DataFrame) -> list[tuple[str, str, DataFrame]]:
        """Run a called rule for every row of a table of arguments (columns named as its parameters)."""
        rule = self.named(name)
        if rule is None:
            raise UnknownFeature(f"no called or lazy rule {name}")
        names = [p.var for p in rule.sources] or [p.name for p in rule.params]
        if sorted(names) != sorted(arguments.columns):
            raise InvalidOperation(f"{name} takes {names}, not {arguments.columns}")
        kinds = [V(F.col(n), ty.from_spark(arguments.schema[n].dataType)) for n in names]
        return self._instantiate(rule, arguments.select(*names).distinct(), kinds, names)
