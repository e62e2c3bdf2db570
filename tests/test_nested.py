import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from triplane.operators import nested
from triplane.operators.nested import contained, element_nodes, entry_nodes, label_columns, label_json, node_table, parse_json, write_node_tables

LISTS = ("links", "edges")


def nodes(spark, plans):
    df = spark.createDataFrame(list(enumerate(plans)), "id long, plan string")
    return label_json(df, "id", "plan", "plan", LISTS)


def test_paths_and_positions(spark):
    plan = {"a": {}, "links": {"x": {"y": 1}}, "edges": [None, {"z": [[{"q": 1}], 2]}, 3], "n": None, "s": "t"}
    got = rows(nodes(spark, [json.dumps(plan), json.dumps(json.dumps(plan)), "{bad", "", None, "3", '{"x": NaN}']).where("kind <> ''"), "id", "path", "pos")
    paths = [("plan", None), ("plan.a", None), ("plan.edges[1]", 1), ("plan.edges[1].z[0][0]", 0), ("plan.links[0]", 0), ("plan.links[0].x", None)]
    assert sorted((r[1], r[2]) for r in got if r[0] == 0) == paths and sorted((r[1], r[2]) for r in got if r[0] == 1) == paths
    assert {r[0] for r in got} == {0, 1}


def test_labels_are_a_tree(spark):
    plan = {"a": {"b": {"c": {}}, "d": [{"e": {}}, {"e": {}}]}, "f": {}}
    got = {r["path"]: r for r in nodes(spark, [json.dumps(plan)]).collect()}
    for p, r in got.items():
        for q, s in got.items():
            inside = q != p and (p == "" or q.startswith(p + ".") or q.startswith(p + "["))
            assert inside == (r["pre"] < s["pre"] and s["post"] < r["post"]), (p, q)
    by_pre = {r["pre"]: p for p, r in got.items()}
    assert all(by_pre[r["parent_pre"]] == p.rpartition(".")[0] for p, r in got.items() if "." in p)
    assert sorted(r["pre"] for r in got.values()) == sorted(r["post"] for r in got.values()) == list(range(len(got)))


def test_nothing_of_a_record_is_lost(spark):
    plan = {"a": 1, "b": ["x", None], "c": {"d": "é", "e": None}}
    got = {r["path"]: json.loads(r["value"]) for r in nodes(spark, [json.dumps(plan)]).where("kind <> ''").collect()}
    assert got == {"plan": {"a": 1, "b": ["x", None]}, "plan.c": {"d": "é", "e": None}}


def test_deep_and_long_records(spark, monkeypatch):
    deep = '{"a":' * 3000 + "{}" + "}" * 3000
    unnamed = '{"":' * 100_000 + '{"x": 1}' + "}" * 100_000
    lists = '{"v":' + "[" * 100_000 + "7" + "]" * 100_000 + "}"
    long = json.dumps({"links": [{"t": "x" * 50}] * 5000})
    monkeypatch.setattr(nested, "ROWS_AT_ONCE", 700)
    got = nodes(spark, [deep, long, unnamed, lists, json.dumps(unnamed)]).groupBy("id").agg(F.max("depth"), F.count("*"), F.max("post"))
    assert rows(got) == [(0, 3001, 3002, 3001), (1, 2, 5002, 5001), (2, 100_001, 100_002, 100_001), (3, 1, 2, 1), (4, 100_001, 100_002, 100_001)]
    assert len(nodes(spark, [lists]).where("kind = 'plan'").first()["value"]) == len(lists)


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, true, false, null, "\\u00e9\\n"], "b": {"c": []}, "a": 2}', " [ ] ", "{}", "3", '"x"', '[1, {"q": ""}]', '{"a":1', "[1,]", '{"a" 1}', "{1: 2}", "01", "[1 2]", "", " ", "nul", '{"a":1}}', "\"\t\"", "NaN", "-", "[}"])
def test_deep_reader_reads_as_the_other_one(text):
    def read(f):
        try:
            return f(text)
        except ValueError:
            return "invalid"

    assert read(nested._load_deep) == read(lambda t: json.loads(t, parse_constant=nested._no_constant))


def test_odd_values(spark):
    digits = "9" * 5000
    assert parse_json('{"n": %s}' % digits) == {"n": digits}
    got = {(r["id"], r["path"]): json.loads(r["value"]) for r in nodes(spark, ['{"links": [1, {"a": "\\ud800"}, [2, {"b": 1}]], "": [3]}', '[{"z": 1}, 5]']).where("kind <> ''").collect()}
    assert got == {(0, "plan"): {"links": [1, None, [2, None]], "": [3]}, (0, "plan.links[1]"): {"a": "\ufffd"}, (0, "plan.links[2][1]"): {"b": 1}, (1, "plan"): {"": [None, 5]}, (1, "plan[0]"): {"z": 1}}


def test_typed_columns_and_plan_make_one_tree(spark, tmp_path):
    kind = "struct<n: string>"
    df = spark.createDataFrame(
        [(1, {"b": 1.0, "a": None}, [None, ("x", {"p": 0.5, "o": None}), ("y", None)], '{"links": [{}]}'), (2, None, None, "[{}]"), (3, {}, [], None)],
        "id long, s map<string, double>, g array<struct<n: string, m: map<string, double>>>, plan string",
    )
    typed = label_columns(df, "id", [entry_nodes("s", kind), element_nodes("g", ["n"], "m", kind)])
    assert rows(typed.where("id = 1").select("pre", "post", "depth", "parent_pre", "pos", "path", "number", "item.n")) == sorted(
        [(1, 0, 1, 0, None, "s[a]", None, None), (2, 1, 1, 0, None, "s[b]", 1.0, None), (3, 4, 1, 0, 1, "g[1]", None, "x"), (4, 2, 2, 3, None, "g[1].m[o]", None, None), (5, 3, 2, 3, None, "g[1].m[p]", 0.5, None), (6, 5, 1, 0, 2, "g[2]", None, "y")],
        key=lambda r: tuple((x is not None, str(x)) for x in r),
    )
    every = typed.drop("number", "item").unionByName(label_json(df, "id", "plan", "plan", LISTS, F.when(F.col("id") == 1, 6)))
    for i in (1, 2, 3):
        got = every.where(f"id = {i}").collect()
        assert sorted(r["pre"] for r in got) == sorted(r["post"] for r in got) == list(range(len(got)))
        up = {r["pre"]: r for r in got}
        assert all(up[r["parent_pre"]]["pre"] < r["pre"] and r["post"] < up[r["parent_pre"]]["post"] and up[r["parent_pre"]]["depth"] == r["depth"] - 1 for r in got if r["pre"])
    assert [r["value"] for r in every.where("path = 'g[2]'").collect()] == ['{"n":"y"}']
    write_node_tables(every, f"{tmp_path}/tables")
    assert spark.read.parquet(f"{tmp_path}/tables").groupBy("kind").count().count() == 6


def test_tables_and_containment(spark):
    n = nodes(spark, [json.dumps({"links": [{"edges": [{"k": 1}, {"k": 2}]}, {"edges": {"k": 3}}]})])
    links, edges = n.where("kind = 'plan.links'"), n.where("kind = 'plan.edges'")
    assert rows(contained(links, edges, "id"), "outer_path", "inner_path") == [("plan.links[0]", "plan.links[0].edges[0]"), ("plan.links[0]", "plan.links[0].edges[1]"), ("plan.links[1]", "plan.links[1].edges[0]")]
    nest = nodes(spark, ['{"links": {"links": {"links": {}, "edges": {}}}, "edges": {"links": {}}}'])
    inner = nest.where("kind = 'plan.links'")
    assert rows(contained(inner, inner, "id"), "outer_path", "inner_path") == [("plan.links[0]", "plan.links[0].links[0]"), ("plan.links[0]", "plan.links[0].links[0].links[0]"), ("plan.links[0].links[0]", "plan.links[0].links[0].links[0]")]
    assert rows(contained(inner, nest.where("kind = 'plan.edges'"), "id"), "inner_path") == [("plan.links[0].links[0].edges[0]",)] * 2
    assert rows(node_table(n, "id", F.col("kind") == "plan.links"), "pos", "parent_pre") == [(0, 1), (1, 1)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, plan string")
    assert label_json(df, "id", "plan", "plan", LISTS).count() == 0
