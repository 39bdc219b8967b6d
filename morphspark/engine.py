"""Engine: modules, queries and transformations over models of DataFrames."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphspark.errors import Diagnostics, InvalidOperation, MissingModel, MorphError, UnknownClass, UnknownOperation
from morphspark.evaluate import Evaluator
from morphspark.lang import ast as A
from morphspark.lang.parser import parse_expression, parse_module
from morphspark.metamodel import Metamodel, Model
from morphspark.operators.ranks import global_rank
from morphspark.plans.compiler import Compiler
from morphspark.plans.rules import RuleSet
from morphspark.plans.values import Frame, ObjV, SetV, TupleV, V, column


#: Depth of lazy rules that ask for lazy rules.
ROUNDS = 20


@dataclass
class RunReport:
    """What a run did; counts are taken by count(), which runs the plans."""

    seconds: float = 0.0
    successful: bool = True
    error: str | None = None
    rules: dict[str, int] = field(default_factory=dict)
    elements: dict[str, int] = field(default_factory=dict)
    #: How often the plans hold each helper and each navigation.
    uses: dict[str, int] = field(default_factory=dict)

    @property
    def created(self) -> int:
        return sum(self.elements.values())

    def efficiency(self) -> float:
        return self.created / self.seconds if self.seconds else 0.0

    def __str__(self) -> str:
        lines = [f"{'done' if self.successful else 'failed: ' + str(self.error)} in {self.seconds:.3f} s, {self.created} elements ({self.efficiency():.0f} a second)"]
        lines += [f"  rule {n}: {c} matches" for n, c in self.rules.items()]
        lines += [f"  class {n}: {c} elements" for n, c in self.elements.items()]
        lines += [f"  {n}: {c} in the plans" for n, c in sorted(self.uses.items())]
        return "\n".join(lines)


class Result:
    """Target models by alias, the trace, and the plans behind them."""

    def __init__(self, models: dict[str, Model], trace: DataFrame, rules: RuleSet, started: float, diagnostics: Diagnostics | None = None):
        self.models, self.trace, self.rules, self.started = models, trace, rules, started
        self.diagnostics = diagnostics or Diagnostics()

    def __getitem__(self, alias: str) -> dict[str, DataFrame]:
        return self.models[alias].tables

    def together(self) -> DataFrame:
        """All targets in one table (_model, _class, _id and every feature, null where a class has none), from one scan for each rule."""
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self.rules.wide)

    def find_element(self, element_id: str) -> DataFrame:
        """model, _id, _class of the element with that id; of the targets if one of them has it, else of the sources."""
        parts = [t.select(F.lit(0).alias("side"), F.lit(a).alias("model"), "_id", "_class") for a, m in self.models.items() for t in m.tables.values()]
        parts += [m.element(element_id).select(F.lit(1).alias("side"), F.lit(a).alias("model"), "_id", "_class") for a, m in self.rules.models.items() if any(map(m.metamodel.key, m.tables))]
        return reduce(DataFrame.union, parts).where(F.col("_id") == element_id).orderBy("side").limit(1).drop("side")

    def extent(self, cls: str) -> DataFrame:
        """All elements of a class by its bare name: a target class if there is one, else a source class."""
        for m in self.models.values():
            if cls in m.tables:
                return m.tables[cls]
        for m in self.rules.models.values():
            if cls in m.metamodel.classes:
                e = m.extent(cls, "e")
                return e.select(*[F.col(f"`{c}`").alias(c.removeprefix("e__").replace("$", "")) for c in e.columns])
        raise UnknownClass(cls)

    def report(self) -> RunReport:
        report = RunReport(uses=dict(self.rules.compiler.uses))
        try:
            report.rules = {r["rule"]: r["n"] for r in self.trace.groupBy("rule").agg(F.count_distinct("source_id").alias("n")).collect()}  # a row a rule
            report.elements = {f"{a}!{c}": t.count() for a, m in self.models.items() for c, t in m.tables.items()}
        except Exception as e:  # noqa: BLE001
            report.successful, report.error = False, str(e)
            self.diagnostics.error(str(e))
        report.seconds = time.time() - self.started
        return report


class Engine:
    def __init__(self, spark: SparkSession, module: A.Module | str | None = None, metamodels: dict[str, Metamodel] | None = None):
        self.spark = spark
        self.module = parse_module(module) if isinstance(module, str) else module
        self.metamodels = metamodels or {}
        self.models: dict[str, Model] = {}
        self.helpers: dict = {}
        self.diagnostics = Diagnostics()

    @classmethod
    def load(cls, spark: SparkSession, path: str | Path, **options) -> Engine:
        from morphspark.sources.resource import load_module

        module, metamodels = load_module(path, **options)
        return cls(spark, module, metamodels)

    def source(self, alias: str, model: Model) -> Engine:
        """Supply the model of an alias (or of a metamodel's name)."""
        self.models[alias] = model
        return self

    def helper(self, name: str, function) -> Engine:
        """Register a helper as a function of columns."""
        self.helpers[name] = function
        return self

    # queries

    def compiler(self) -> Compiler:
        rules = RuleSet(self.module, self.models, {}, self.helpers) if self.module and self.models else None
        return rules.compiler if rules else Compiler(self.module, self.models, self.helpers)

    def query(self, name: str) -> DataFrame:
        q = next((q for q in self.module.queries if q.name == name), None)
        if q is None:
            raise UnknownOperation(f"no query {name}")
        return self.evaluate(q.body)

    def evaluate(self, expression: A.Expr | str, position: str | None = None) -> DataFrame:
        """The value of an expression as rows: tuples a column a field, elements their attributes, else `value`.

        A sequence comes in its order. ``position`` names a column for the 1-based place in it.
        """
        e = parse_expression(expression) if isinstance(expression, str) else expression
        compiler = self.compiler()
        one = Frame(self.spark.range(1), [])
        return to_frame(compiler.lower(e, {}, one), one, compiler, position)

    def explain(self, expression: A.Expr | str, mode: str = "formatted") -> str:
        """The physical plan of an expression."""
        df = self.evaluate(expression)
        return self.spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def cache(self) -> Engine:
        """Keep the source tables once they have been read."""
        for m in self.models.values():
            m.cache()
        return self

    def clear_caches(self) -> None:
        for m in self.models.values():
            m.uncache()

    def cache_statistics(self) -> dict[str, int]:
        """Tables of each source model that are kept."""
        return {a: sum(t.storageLevel.useMemory for t in m.tables.values()) for a, m in self.models.items()}

    def constant(self, expression: A.Expr | str):
        """The value of an expression that needs no model, on the driver."""
        e = parse_expression(expression) if isinstance(expression, str) else expression
        return Evaluator(self.module, self.helpers).eval(e)

    # transformations

    def run(self, targets: dict[str, Metamodel] | None = None, strict: bool = False) -> Result:
        """Run all matched rules and the lazy and called rules they ask for. Lazy: nothing is computed yet.

        strict: a reference to an element that no rule matched is an error when it is read, not null.
        """
        try:
            return self._run(targets, strict)
        except MorphError as e:
            self.diagnostics.error(f"{type(e).__name__}: {e}")
            raise

    def _run(self, targets: dict[str, Metamodel] | None, strict: bool) -> Result:
        started = time.time()
        for w in self.module.warnings:
            self.diagnostics.warning(w)
        for alias, mm in self.module.sources:
            if alias not in self.models and mm not in self.models and not any(m.metamodel.name in (alias, mm) for m in self.models.values()):
                raise MissingModel(f"no model for source {alias}")
        models = dict(self.models)
        for alias, mm in self.module.sources:  # rules name metamodels, callers may name aliases
            for known, m in self.models.items():
                if known in (alias, mm) or m.metamodel.name in (alias, mm):
                    models[known] = m
        known = {**{mm: self.metamodels.get(mm) for _, mm in self.module.targets}, **(targets or {})}
        out = {alias: Model(known.get(mm) or known.get(alias) or Metamodel(mm), {}, writable=True) for alias, mm in self.module.targets}
        rules = RuleSet(self.module, models, out, self.helpers, strict)
        made: list[tuple[str, str, DataFrame]] = []
        for rule in self.module.rules:
            if rule.kind == "matched":
                made += rules.run_matched(rule)
                self.diagnostics.event(f"rule {rule.name} planned")
        done, lazy = {}, {}
        for _ in range(ROUNDS):  # targets of lazy rules may ask for more of them
            todo = [n for n, asked in rules.requests.items() if len(asked) > done.get(n, 0)]
            if not todo:
                break
            for name in todo:
                done[name] = len(rules.requests[name])
                lazy[name] = rules.run_requested(rules.named(name))
        else:
            raise InvalidOperation("lazy rules that ask for themselves without end")
        made += [x for parts in lazy.values() for x in parts]
        by: dict[tuple[str, str], list[DataFrame]] = {}
        for alias, cls, df in made:
            by.setdefault((alias, cls), []).append(df)
        for (alias, cls), parts in by.items():
            model = next((m for a, m in out.items() if alias in (a, m.metamodel.name)), None) or next(iter(out.values()))
            rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            model.tables[cls] = model.created[cls] = rows
        return Result(out, rules.trace(), rules, started, self.diagnostics)

    def call(self, rule: str, arguments: DataFrame) -> dict[str, DataFrame]:
        """Targets by class of a called rule, for every row of arguments."""
        rules = RuleSet(self.module, self.models or {"IN": Model(Metamodel("IN"), {})}, {}, self.helpers)
        out: dict[str, DataFrame] = {}
        for _, cls, df in rules.call(rule, arguments):
            out[cls] = out[cls].unionByName(df, allowMissingColumns=True) if cls in out else df
        return out


def to_frame(v, one: Frame, compiler: Compiler, position: str | None = None) -> DataFrame:
    if isinstance(v, SetV):
        if v.kind in ("Sequence", "OrderedSet") and v.order and not v.group() and not isinstance(v.element, SetV):
            v.frame.df = global_rank(v.frame.df, v.order, position) if position else v.frame.df.orderBy(*v.order)
        place = [position] if position else []
        e, df = v.element, v.frame.df
        if isinstance(e, SetV):
            v = compiler.flatten(v)
            e, df = v.element, v.frame.df
        if isinstance(e, ObjV):
            compiler.load(e, v.frame)
            mm = compiler.models[e.alias].metamodel
            names = [n for n in mm.features(e.cls) if f"{e.prefix}__{n}" in v.frame.df.columns]
            return v.frame.df.select(*[F.col(f"{e.prefix}__{n}").alias(n) for n in names], *place)
        if isinstance(e, TupleV):
            return df.select(*[column(x).alias(n) for n, x in e.fields.items()], *place)
        return df.select(column(e).alias("value"), *place)
    if isinstance(v, TupleV):
        return one.df.select(*[column(x).alias(n) for n, x in v.fields.items()])
    if isinstance(v, ObjV):
        compiler.load(v, one)
        mm = compiler.models[v.alias].metamodel
        return one.df.select(*[F.col(f"{v.prefix}__{n}").alias(n) for n in mm.features(v.cls) if f"{v.prefix}__{n}" in one.df.columns])
    if isinstance(v, V):
        return one.df.select(v.col.alias("value"))
    return one.df.select(column(v).alias("value"))
