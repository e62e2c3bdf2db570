"""Node tables of problem 3: together they hold every object of a run once, with its place and its fields."""

import json

from conftest import rows
from triplane.suite.quality import PLAN_TABLES, QUERIES

NODE = ["run_id", "path", "pre", "post", "depth", "parent_pre", "pos", "name", "value"]
TABLES = ["p3_plan", *(f"p3_plan_{f}" for f in PLAN_TABLES), "p3_plan_others"]
PLAN = {
    "shape": "list", "limit": 3, "notes": ["a", "b"], "subject": {"iri": "i", "label": "l", "types": ["t"]},
    "links": [None, {"anchor": {"iri": "x", "label": "y"}, "path": {"score": 0.5, "edges": [{"kind": "hop", "steps": {"prop": "p", "inverse": True}, "target": {"class": "C"}}]}}],
    "filters": [{"op": "eq", "literal": {"kind": "date", "value": 7, "range": {"low": "a", "high": None}}}],
    "answer_path": {"score": 1.5}, "compare": [{"iri": "k"}], "decisions": [{"name": "n", "choice": "c", "alternatives": [{"option": "o", "p": 0.25}]}],
    "a.edges": {"odd": 1},
}


def table(spark, tmp_path):
    schema = "run_id long, stages map<string, double>, gates array<struct<name: string, choice: string, confidence: double, threshold: double, passed: boolean, probabilities: map<string, double>>>, plan string, loaded_at timestamp"
    spark.createDataFrame([(1, {"parse": 2.5, "run": None}, None, json.dumps(PLAN), None), (2, None, None, "[{}]", None), (3, None, None, "{bad", None)], schema).write.parquet(f"{tmp_path}/eval_run.parquet")
    return str(tmp_path)


def test_every_object_is_in_one_table(spark, tmp_path):
    d = table(spark, tmp_path)
    found = [r for t in TABLES for r in rows(QUERIES[t](spark, d), "run_id", "path")]
    want = [r for r in rows(QUERIES["p3_found"](spark, d)) if r[1].startswith("plan")] + [(1, "plan"), (2, "plan")]
    assert sorted(found) == sorted(want) and len(set(found)) == len(found)


def test_places_and_fields(spark, tmp_path):
    d = table(spark, tmp_path)
    one = lambda t: QUERIES[t](spark, d).where("run_id = 1").collect()
    got = {t: one(t) for t in TABLES}
    assert all(len(v) == 1 for v in got.values())
    assert all(set(NODE) <= set(r.asDict()) for v in got.values() for r in v)
    up = lambda t, parent: got[t][0]["parent_pre"] == got[parent][0]["pre"]
    assert up("p3_plan_links", "p3_plan") and up("p3_plan_edges", "p3_plan_path") and up("p3_plan_steps", "p3_plan_edges") and up("p3_plan_range", "p3_plan_literal")
    assert got["p3_plan_links"][0]["pos"] == 1 and got["p3_plan_steps"][0]["pos"] == 0 and got["p3_plan_range"][0]["pos"] is None
    field = {"p3_plan": {"shape": "list", "limit": "3", "notes": '["a","b"]'}, "p3_plan_subject": {"iri": "i", "label": "l", "types": '["t"]'}, "p3_plan_steps": {"prop": "p", "inverse": "true", "module": None}, "p3_plan_literal": {"kind": "date", "value": "7"}, "p3_plan_range": {"low": "a", "high": None}, "p3_plan_alternatives": {"option": "o", "p": "0.25"}}
    for t, fields in field.items():
        begin = PLAN_TABLES[t.removeprefix("p3_plan_")][0] if t != "p3_plan" else "plan"
        assert {f: got[t][0][f"{begin}_{f}"] for f in fields} == fields, t
    assert json.loads(got["p3_plan_others"][0]["value"]) == {"odd": 1}


def test_stages_keep_their_labels(spark, tmp_path):
    got = QUERIES["p3_stage_nodes"](spark, table(spark, tmp_path))
    assert set(NODE) <= set(got.columns)
    assert rows(got, "run_id", "path", "pre", "parent_pre", "stage", "ms") == [(1, "stages[parse]", 1, 0, "parse", 2.5), (1, "stages[run]", 2, 0, "run", None)]
