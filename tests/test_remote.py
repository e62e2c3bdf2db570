import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from triplane.sources.remote import Endpoint, RemoteTimeout, construct_split, fetch, stage


def reply(url, form, accept, timeout):
    q = form["query"]
    if "slow" in q:
        return 504, "gateway"
    if "broken" in q:
        return 400, "bad key"
    if accept.endswith("triples"):
        return 200, "\n".join(f"<{k}> <p> <o> ." for k in q.split())
    if q.startswith("ASK"):
        return 200, '{"boolean": true}'
    term = lambda v, kind=None: {"type": "literal", "value": v} | ({"datatype": "http://www.w3.org/2001/XMLSchema#" + kind} if kind else {})
    return 200, json.dumps({"head": {"vars": ["a", "b"]}, "results": {"bindings": [{"a": term("3", "integer"), "b": term("x", "integer")}, {"b": {"type": "bnode", "value": "n"}}]}})


def test_queries():
    e = Endpoint("http://e", reply)
    assert e.select("SELECT") == [{"a": 3, "b": "x"}, {"a": None, "b": "_:n"}] and e.ask("ASK {}")
    with pytest.raises(RemoteTimeout):
        e.select("slow")


def test_busy_endpoints_are_tried_again():
    said = [(429, "busy"), (503, "busy"), (200, '{"boolean": false}')]
    assert Endpoint("http://e", lambda *_: said.pop(0), wait=0).ask("ASK {}") is False
    with pytest.raises(RuntimeError, match="500"):
        Endpoint("http://e", lambda *_: (500, "x"), tries=2, wait=0).ask("ASK {}")


def test_one_bad_key_costs_no_other():
    lines, bad = construct_split(["a", "b", "broken", "c", "d"], " ".join, Endpoint("http://e", reply))
    assert len(lines) == 4 and bad == ["broken"]


def test_copy(spark, tmp_path):
    keys = spark.createDataFrame([(k,) for k in ("a", "b", "broken", "c", "a", None)], "k string")
    quads, bad = fetch(keys, "k", " ".join, Endpoint("http://e", reply), "g", 2)
    assert rows(quads, "g", "s") == [("g", "a"), ("g", "b"), ("g", "c")] and rows(bad) == [("broken",)]
    made = []
    for _ in range(2):
        t = stage(spark, str(tmp_path / "t"), lambda: made.append(1) or keys)
    assert t.count() == 6 and made == [1]


def test_an_endpoint_is_a_store(spark):
    from graphs import PREFIXES, D, quads

    from triplane.plans.algebra import Compiler
    from triplane.sources.quads import to_lines
    from triplane.sources.remote import EndpointStore
    from triplane.sources.store import QuadStore

    inside = Compiler(QuadStore(quads(spark)), {})

    def answer(url, form, accept, timeout):
        q = form["query"]
        if q.startswith("CONSTRUCT"):
            return 200, "\n".join(r[0] for r in to_lines(inside.construct(q).withColumn("g", F.lit(None).cast("string"))).collect())
        found = [r[0] for r in inside.select(q).collect()]
        return 200, json.dumps({"head": {"vars": ["g"]}, "results": {"bindings": [{"g": {"type": "uri", "value": x}} for x in found]}})

    store = EndpointStore(spark, Endpoint("http://e", answer))
    for text in ("SELECT ?b ?t WHERE { ?b o:builtBy ?y . ?y o:town ?t }", "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s a ?c } } GROUP BY ?g", f"SELECT ?l WHERE {{ <{D}gull> o:length ?l FILTER(?l > 1) }}"):
        assert rows(Compiler(store, PREFIXES).select(text)) == rows(Compiler(QuadStore(quads(spark)), PREFIXES).select(text))
    assert Compiler(store, PREFIXES).ask("ASK { d:gull a o:Sloop }")
