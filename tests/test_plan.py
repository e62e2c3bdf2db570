import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from triplane.plans.algebra import Compiler
from triplane.plans.plan import Filter, Link, Literal, PlanCompiler, PlanError, QueryPlan, Step, read, year
from triplane.sources.store import Entity, MappedStore, Property, QuadStore

T = "http://t/"


def stores(spark):
    boats = spark.createDataFrame([(1, "Gull", 10, 9.5, dt.datetime(2019, 12, 31, 23, 59, 59, 500000)), (2, "Tern", 10, 12.0, dt.datetime(2020, 1, 1)), (3, "Orca", 11, 12.0, None), (4, None, None, None, None)], "id long, name string, yard int, length double, launched timestamp_ntz")
    yards = spark.createDataFrame([(10, "North"), (11, "South")], "id int, name string")
    m = MappedStore([
        Entity(T + "g1", T + "Boat", boats, "id", T + "boat/{}", [Property(T + "name", "name"), Property(T + "yard", "yard", T + "yard/{}"), Property(T + "length", "length"), Property(T + "launched", "launched")]),
        Entity(T + "g2", T + "Yard", yards, "id", T + "yard/{}", [Property(T + "name", "name")]),
    ])
    return {"virtual": m, "quads": QuadStore(m.quads())}


@pytest.fixture(scope="module", params=["virtual", "quads"])
def pc(spark, request):
    return PlanCompiler(stores(spark)[request.param])


BOATS = {"classes": (T + "Boat",), "graph": T + "g1"}
LENGTH, YARD = (Step(T + "length", graph=T + "g1"),), (Step(T + "yard", graph=T + "g1"),)


def got(pc, **plan):
    return read(pc.compile(QueryPlan(**plan)))


def test_shapes(pc):
    north = Link(YARD, T + "yard/10")
    assert got(pc, shape="count", **BOATS)["values"] == [4]
    assert got(pc, shape="count", **BOATS, links=(north,))["values"] == [2]
    assert sorted(got(pc, shape="list", **BOATS, links=(north,))["values"]) == [T + "boat/1", T + "boat/2"]
    assert got(pc, shape="aggregate", **BOATS, path=LENGTH, agg="sum")["values"] == [33.5]
    assert sorted(got(pc, shape="superlative", **BOATS, path=LENGTH)["values"]) == [T + "boat/2", T + "boat/3"]
    assert got(pc, shape="superlative", **BOATS, path=LENGTH, order="asc")["values"] == [T + "boat/1"]
    assert got(pc, shape="path", subject=T + "boat/1", path=(*YARD, Step(T + "name", graph=T + "g2")))["values"] == ["North"]
    assert sorted(got(pc, shape="lookup", subject=T + "yard/10", path=(Step(T + "yard", True, T + "g1"),))["values"]) == [T + "boat/1", T + "boat/2"]
    assert got(pc, shape="compare", compare=(T + "boat/1", T + "boat/2", T + "boat/9"), path=LENGTH)["values"] == [T + "boat/2"]
    assert got(pc, shape="boolean", subject=T + "boat/1", links=(north,))["values"] == [True]
    assert got(pc, shape="boolean", subject=T + "boat/3", links=(north,))["values"] == [False]


def test_empty_answers_differ(pc):
    none = (Filter(LENGTH, "gt", Literal("number", 99)),)
    zero = got(pc, shape="count", **BOATS, filters=none)
    assert zero["values"] == [0] and zero["empty"]
    nothing = got(pc, shape="aggregate", **BOATS, filters=none, path=LENGTH, agg="sum")
    assert nothing["values"] == [] and nothing["empty"]
    assert pc.relaxed_count(QueryPlan("aggregate", **BOATS, filters=none)).first()["answer"] == 4


@pytest.mark.parametrize(("op", "n"), [("eq", 1), ("gt", 0), ("ge", 1), ("lt", 1), ("le", 2)])
def test_periods_are_half_open(pc, op, n):
    """The last half second of 2019 is in 2019, the first instant of 2020 is not."""
    f = (Filter((Step(T + "launched", graph=T + "g1"),), op, year(2020), temporal=True),)
    assert got(pc, shape="count", **BOATS, filters=f)["values"] == [n]


def test_string_and_class_filters(pc):
    f = (Filter((*YARD, Step(T + "name", graph=T + "g2")), "eq", Literal("string", "South")),)
    assert got(pc, shape="count", **BOATS, filters=f)["values"] == [1]
    assert got(pc, shape="count", classes=(T + "Boat", T + "Yard"))["values"] == [6]
    assert got(pc, shape="count", classes=())["values"] == [0]


def test_what_a_plan_lacks(pc):
    for plan in (QueryPlan("lookup"), QueryPlan("aggregate", agg="sum"), QueryPlan("aggregate", path=LENGTH, agg="median"), QueryPlan("unsupported"), QueryPlan("boolean")):
        with pytest.raises(PlanError):
            pc.compile(plan)


def test_one_scan_serves_a_star(spark):
    m = stores(spark)["virtual"]
    df = Compiler(m, {"t": T}, merged=False).select("SELECT ?b ?n WHERE { ?b a t:Boat ; t:name ?n ; t:length ?l FILTER(?l > 10) }")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and rows(df, "n") == [("Orca",), ("Tern",)]


def test_repartitioning_changes_nothing(spark):
    m = stores(spark)["virtual"]
    q = m.quads()
    many = QuadStore(q.repartition(13, F.col("o")))
    text = "SELECT ?y (COUNT(*) AS ?n) WHERE { ?b t:yard ?y } GROUP BY ?y"
    assert rows(Compiler(many, {"t": T}).select(text)) == rows(Compiler(QuadStore(q), {"t": T}).select(text)) == rows(Compiler(m, {"t": T}).select(text))
