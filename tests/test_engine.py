import math
import random
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from morphspark import queries as Q
from morphspark.engine import Engine
from morphspark.errors import InvalidOperation, MissingModel, ReadOnlyModel, UnknownFeature, UnsupportedFormat
from morphspark.evaluate import Evaluator
from morphspark.lang.parser import parse_expression
from morphspark.metamodel import Metamodel, Model, Reference
from morphspark.operators.ranks import global_rank, totals_upto
from morphspark.sources.resource import load_model, save_model
from tests.test_language import CASES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_against_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    r = duck.execute(Q.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(x[names.index(c)] for c in columns) for x in r.fetchall()), key=str)


def depot(spark):
    mm = Metamodel("Depot")
    mm.add("Parcel", {"id": "Integer", "label": "String", "weight": "Integer"}, [Reference("courier", "Courier", "courier")], "id")
    mm.add("Courier", {"id": "Integer", "name": "String"}, [Reference("parcels", "Parcel", opposite="courier")], "id")
    parcels = spark.createDataFrame([(1, "lamp", 3, 7), (2, "anvil", 60, 7), (3, "stool", 5, None)], "id long, label string, weight int, courier long")
    return Model(mm, {"Parcel": parcels, "Courier": spark.createDataFrame([(7, "Ada"), (8, "Bo")], "id long, name string")})


ROUTES = """module Routes; create OUT : Plan from IN : Depot;
helper context Depot!Parcel def : needsVan() : Boolean = self.weight > 20 or self.courier.oclIsUndefined();
rule Van { from p : Depot!Parcel (p.needsVan()) to t : Plan!Ride (title <- p.label + '!') }
rule Bike { from p : Depot!Parcel (not p.needsVan()) to t : Plan!Trip (title <- p.label, by <- p.courier.name) }
"""


def test_parcels_become_rides(spark):
    engine = Engine(spark, ROUTES).source("IN", depot(spark))
    out = engine.run()
    assert sorted(r.title for r in out["OUT"]["Ride"].collect()) == ["anvil!", "stool!"]
    assert [(r.title, r.by) for r in out["OUT"]["Trip"].collect()] == [("lamp", "Ada")]
    report = out.report()
    assert report.rules == {"Van": 2, "Bike": 1} and report.created == 3 and "3 elements" in str(report)
    assert report.uses["helper needsVan"] >= 2 and report.uses["navigation Courier"] >= 1
    assert [x[2] for x in engine.diagnostics.timeline] == ["rule Van planned", "rule Bike planned"]


def test_checks(spark):
    engine = Engine(spark, ROUTES)
    with pytest.raises(MissingModel):
        engine.run()
    assert engine.diagnostics.errors == ["MissingModel: no model for source IN"]
    target = Metamodel("Plan")
    target.add("Ride", {"other": "String"})
    target.add("Trip", {"title": "String", "by": "String"})
    with pytest.raises(UnknownFeature):
        Engine(spark, ROUTES).source("IN", depot(spark)).run({"Plan": target})
    with pytest.raises(ReadOnlyModel):
        depot(spark).add("Parcel", spark.range(1))


def test_model_services(spark, tmp_path):
    m = depot(spark)
    assert m.all_elements().count() == 5 and m.find("Parcel", lambda f: f("weight") > 29).first()._id == "Parcel:2"
    assert m.contains(m.element("Parcel:2").select("_id")).count() == 1
    out = Model(m.metamodel, m.tables, writable=True)
    out.add("Parcel", spark.createDataFrame([(4, "bench")], "id long, label string"))
    out.remove("Parcel", spark.createDataFrame([(1,)], "id long"))
    assert out.tables["Parcel"].count() == 3 and out.statistics()["created"] == 1
    for fmt in ("parquet", "json"):
        save_model(m, f"file://{tmp_path}/{fmt}", fmt)
        back = load_model(spark, m.metamodel, f"file://{tmp_path}/{fmt}", fmt)
        assert sorted(r._id for r in back.all_elements().collect()) == sorted(r._id for r in m.all_elements().collect())
    with pytest.raises(UnsupportedFormat):
        save_model(m, str(tmp_path), "doc")


def test_caches_and_plans(spark):
    engine = Engine(spark, ROUTES).source("IN", depot(spark)).cache()
    assert engine.cache_statistics() == {"IN": 2}
    assert "InMemoryTableScan" in engine.explain("Depot!Parcel.allInstances()->collect(p | Tuple{l = p.label})", "simple")
    engine.clear_caches()
    assert engine.cache_statistics() == {"IN": 0}


def test_order_of_results(spark):
    engine = Engine(spark, ROUTES).source("IN", depot(spark))
    assert [r.l for r in engine.evaluate("Depot!Parcel.allInstances()->sortedBy(p | p.label)->collect(p | Tuple{l = p.label})").collect()] == ["anvil", "lamp", "stool"]
    assert [(r.l, r.i) for r in engine.evaluate("Depot!Parcel.allInstances()->sortedBy(p | -p.weight)->collect(p | Tuple{l = p.label})", position="i").orderBy("i").collect()] == [("anvil", 1), ("stool", 2), ("lamp", 3)]
    rows = engine.evaluate("Depot!Courier.allInstances()->collect(c | Tuple{n = c.name, u = c.parcels->isUnique(p | p.courier), s = c.parcels->sortedBy(p | -p.weight)->collect(p | p.label)})").collect()
    assert {r.n: list(r.s) for r in rows} == {"Ada": ["anvil", "lamp"], "Bo": []}


def test_recursive_helpers(spark, monkeypatch):
    module = """module R; create OUT : O from IN : Depot;
    helper def : fact(n : Integer) : Integer = if n < 2 then 1 else n * fact(n - 1) endif;
    helper def : pow(b : Integer, n : Integer) : Integer = if n = 0 then 1 else b * thisModule.pow(b, n - 1) endif;
    helper def : odd(n : Integer) : Integer = if n <= 0 then n else n + odd(n - 2) endif;
    helper def : fib(n : Integer) : Integer = if n < 2 then n else fib(n - 1) + fib(n - 2) endif;
    helper context Depot!Parcel def : round() : Integer = self.courier.load() + 1;
    helper context Depot!Courier def : load() : Integer = self.parcels->collect(p | p.round())->sum();"""
    engine = Engine(spark, module).source("IN", depot(spark))
    df = engine.evaluate("Depot!Parcel.allInstances()->collect(p | Tuple{w = p.weight, f = fact(p.id + 3), p = pow(p.id, 4), o = odd(p.weight), z = odd(0 - p.id), b = fib(p.id + 5)})")
    rows = sorted(df.collect(), key=lambda r: r.w)
    odd = lambda n: n if n <= 0 else n + odd(n - 2)
    assert [(r.w, r.f, r.p, r.o, r.z, r.b) for r in rows] == [(3, 24, 1, odd(3), -1, 8), (5, 720, 81, odd(5), -3, 21), (60, 120, 16, odd(60), -2, 13)]
    assert "ArrowEvalPython" not in engine.evaluate("Depot!Parcel.allInstances()->collect(p | Tuple{f = fact(p.id)})")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="without end"):
        engine.evaluate("Depot!Parcel.allInstances()->collect(p | Tuple{p = pow(2, 0 - p.id)})").collect()
    monkeypatch.setattr("morphspark.plans.compiler.LEVELS", 4)
    with pytest.raises(InvalidOperation, match="without end"):
        engine.evaluate("Depot!Courier.allInstances()->collect(c | Tuple{l = c.load()})")


def test_global_rank(spark):
    df = spark.range(0, 5000).selectExpr("id % 700 as v", "id")
    got = global_rank(df, [F.col("v"), F.col("id")], "i", bounds=7).orderBy("v", "id").select("i").collect()
    assert [r.i for r in got] == list(range(1, 5001))
    plan = global_rank(df, [F.col("v"), F.col("id")], "i")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("windowspecdefinition(") == plan.count("windowspecdefinition(i$range") > 0
    assert global_rank(df.limit(0), [F.col("v")], "i").count() == 0


def test_totals_upto(spark):
    """Ties, NaN and a group over many ranges, by brute force."""
    rng = random.Random(5)
    value = lambda: rng.choice([math.nan, math.inf, -0.0, 0.0, 1.0, 1.0, 1.0, round(rng.uniform(-2, 2), 1)])
    asking, given = ([(rng.choice([1, 1, 1, 2, 3]), value(), i) for i in range(n)] for n in (90, 70))
    a, g = spark.createDataFrame(asking, "g long, v double, tie long"), spark.createDataFrame([(*r, r[2] % 7) for r in given], "g long, v double, tie long, x long")
    key = lambda v: (1, 0.0) if math.isnan(v) else (0, v)
    tests = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    for (op, test), groups in product(tests.items(), (["g"], [])):
        for how, fn in (("sum", sum), ("max", max)):
            met = {t: [r[2] % 7 for r in given if (r[0] == k or not groups) and test(key(r[1]), key(v))] for k, v, t in asking}
            wanted = {t: fn(x) if x else None for t, x in met.items()}
            for spread in (True, False) if groups else (True,):
                assert {r.tie: r.total for r in totals_upto(a, g, groups, how, op, spread, bounds=6).collect()} == wanted, (op, how, spread)


def _most_rows(plan) -> int:
    """The largest number of rows that an operator of an executed plan put out."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _most_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _most_rows(plan.plan())
    own = plan.metrics().get("numOutputRows")
    below = plan.children()
    return max([own.get().value() if own.isDefined() else 0, *(_most_rows(below.apply(i)) for i in range(below.size()))])


@pytest.mark.parametrize("test,made,want", [
    ("Shop!Lot.allInstances()->select(l | l.hall = b.hall and l.price > b.purse)->size()", "n", lambda b, l: l[1] == b[1] and l[2] > b[2]),
    ("Shop!Lot.allInstances()->select(l | l.hall = b.hall)->exists(l | l.price > b.purse)", "any", lambda b, l: l[1] == b[1] and l[2] > b[2]),
    ("Shop!Lot.allInstances()->select(l | l.price <= b.purse and l.id < 1500)->collect(l | l.id)->sum()", "sum", lambda b, l: l[2] <= b[2] and l[0] < 1500),
    ("b.hall.lots->select(l | l.id <> b.id and b.purse > l.price)->size()", "n", lambda b, l: l[1] == b[1] and l[0] != b[0] and b[2] > l[2]),
])
def test_comparisons_make_no_pairs(spark, test, made, want):
    """Elements compared with each row's values: right, and no operator has the pairs (here up to 4,000,000) as rows."""
    rng = random.Random(11)
    price = lambda: rng.choice([None, 5.0, 5.0, round(rng.uniform(0, 10), 1)])
    bidders = [(i, rng.choice([None, 1, 1, 1, 1, 1, 2]), price()) for i in range(2000)]
    lots = [(i, rng.choice([None, 1, 1, 1, 1, 1, 3]), price()) for i in range(2000)]
    mm = Metamodel("Shop")
    mm.add("Hall", {"id": "Integer"}, [Reference("lots", "Lot", opposite="hall")], "id")
    mm.add("Bidder", {"id": "Integer", "purse": "Real"}, [Reference("hall", "Hall", "hall")], "id")
    mm.add("Lot", {"id": "Integer", "price": "Real"}, [Reference("hall", "Hall", "hall")], "id")
    model = Model(mm, {"Hall": spark.range(1, 4), "Bidder": spark.createDataFrame(bidders, "id long, hall long, purse double"), "Lot": spark.createDataFrame(lots, "id long, hall long, price double")})
    df = Engine(spark, "module A; create OUT : O from IN : Shop;").source("IN", model).evaluate(f"Shop!Bidder.allInstances()->collect(b | Tuple{{k = b.id, v = {test}}})")
    got = {r.k: r.v for r in df.collect()}
    full = lambda b, l: None not in (b[2], l[2]) and ("hall" not in test or None not in (b[1], l[1])) and want(b, l)
    met = {b[0]: [l[0] for l in lots if full(b, l)] for b in bidders}
    assert got == {k: {"n": len, "any": bool, "sum": sum}[made](x) for k, x in met.items()}
    assert _most_rows(df._jdf.queryExecution().executedPlan()) < 100_000


@pytest.mark.parametrize("text,value", [c for c in CASES if c[0] not in ("3 <- 1",) and not isinstance(c[1], dict)])
def test_columns_agree_with_the_driver(spark, text, value):
    """Every case again over columns: literals become variables of a one-row extent."""
    mm = Metamodel("M")
    mm.add("One", {"id": "Integer"}, [], "id")
    e = Engine(spark, "module X; create OUT : O from IN : M;").source("IN", Model(mm, {"One": spark.range(1)}))
    got = e.evaluate(f"M!One.allInstances()->collect(o | Tuple{{v = let zero : Integer = o.id in {text}}})").first().v
    assert (sorted(got) == sorted(value)) if isinstance(value, list) else got == value


def test_random_folds_agree(spark):
    rng = random.Random(7)
    mm = Metamodel("M")
    mm.add("One", {"id": "Integer"}, [], "id")
    e = Engine(spark, "module X; create OUT : O from IN : M;").source("IN", Model(mm, {"One": spark.range(1)}))
    for _ in range(6):
        items = ",".join(f"o.id + {rng.randint(0, 9)}" for _ in range(rng.randint(1, 6)))
        for op in ("select(x | x > 4)->size()", "sortedBy(x | -x)->last()", "asSet()->size()", "iterate(x; a : Integer = 1 | a * 2 + x)", "reject(x | x.isEven())->sum()"):
            text = f"Sequence{{{items}}}->{op}"
            assert e.evaluate(f"M!One.allInstances()->collect(o | Tuple{{v = {text}}})").first().v == Evaluator().eval(parse_expression(text), {"o": {"id": 0}})


def test_plans(spark):
    def plan(name):
        return Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,5000.0)]" in plan("select_filter")
    assert "LeftSemi" in plan("exists_semi") and "LeftAnti" in plan("forall_anti")
    assert plan("nav_chain").count("FileScan") == 3
    assert "LeftSemi" in plan("includes_semi") and "LeftAnti" in plan("excludes_anti")
    assert "SinglePartition" not in plan("at_per_parent")
    assert plan("rule_two_targets").count("FileScan") == 1 and plan("trace_links").count("FileScan") <= 2


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
