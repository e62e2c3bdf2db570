import json

import pytest
from graphs import ONTOLOGY, PREFIXES, SHAPES, D, O, quads

from conftest import rows
from triplane.catalog.cards import LABELS, build_catalog
from triplane.control.decisions import Choice, Decision, LexicalController, RecordingController, Scale, YesNo
from triplane.control.models import CachedModel, HttpModel, ModelController, ModelUnavailable, NullModel, RemoteController, ScriptedModel, chances, first_object
from triplane.control.pipeline import GATES, Pipeline, Trace, projection, with_prefixes
from triplane.control.verify import Verifier, explain
from triplane.evaluation.benchmarks import answerable
from triplane.evaluation.runner import evaluate
from triplane.linking.index import EntityIndex, entity_records
from triplane.plans.plan import Filter, Link, Literal, QueryPlan, Step
from triplane.plans.sparql import parse
from triplane.sources.quads import quads_from_text
from triplane.sources.sample import sample_quads, sample_turtle
from triplane.sources.store import QuadStore


@pytest.fixture(scope="module")
def parts(spark):
    q = quads(spark).cache()
    return QuadStore(q), build_catalog(q, quads_from_text(spark, ONTOLOGY), quads_from_text(spark, SHAPES)), EntityIndex(entity_records(q, LABELS).cache())


class Says:
    """Decides as it is told, by the name of the question; else as words do."""

    def __init__(self, **said):
        self.said, self.asked = said, []

    def ask(self, state, choices):
        self.asked.append((state, choices))
        got = LexicalController().ask(state, choices)
        return {k: self.said.get(k, d) for k, d in got.items()}


# ---------------------------------------------------------------- decisions and models
def test_other_questions():
    c = RecordingController(LexicalController())
    got = c.ask("a fast boat", {"y": YesNo("?", 0.8), "u": YesNo("?"), "s": Scale("speed?", ["slow boat", "fast boat", "none at all"]), "c": Choice("?", {"a": "boat", "b": "car"})})
    assert got["y"].verdict() == "yes" and got["u"].verdict() == "unknown" and YesNo("?", 0.1) and got["c"].choice == "a"
    assert got["s"].choice == "1" and 0 < got["s"].score < 2 and len(c.records) == 1 and set(c.records[0]["decisions"]) == {"y", "u", "s", "c"}


def test_what_a_model_says_is_cut_to_chances():
    assert first_object("I think {bad} {\"a\": {\"x\": 3}} done") == {"a": {"x": 3}} and first_object("none") == {}
    assert chances({"a": 3, "b": -1, "z": 9, "c": "x"}, ["a", "b", "c"]) == {"a": 1.0, "b": 0.0, "c": 0.0}
    assert chances(None, ["a", "b"]) == {"a": 0.5, "b": 0.5} and chances("b", ["a", "b"])["b"] == 1.0 and chances({"a": float("nan")}, ["a"]) == {"a": 1.0}
    said = ScriptedModel([json.dumps({"c": {"a": 0.2, "b": 0.6}, "y": {"yes": 2}}), "no JSON"])
    m = ModelController(said)
    ask = {"c": Choice("?", {"a": "x", "b": "y"}), "y": YesNo("?"), "s": Scale("?", ["l", "h"])}
    got = m.ask("state", ask)
    assert got["c"].choice == "b" and got["c"].confidence == pytest.approx(0.75) and got["y"].yes == 1 and got["s"].probabilities == {"0": 0.5, "1": 0.5}
    assert m.ask("state", ask)["y"].yes == 0.5 and "state" in said.prompts[0]


def test_models_over_http(tmp_path, monkeypatch):
    replies, seen = [(429, "busy"), (200, json.dumps({"choices": [{"message": {"content": "hi"}}]}))], []

    def send(url, headers, body, timeout):
        seen.append((headers, body, timeout))
        return replies.pop(0)

    monkeypatch.setenv("MODEL_API_KEY", "k")
    m = CachedModel(HttpModel("http://m", "small", send=send, sleep=lambda s: None), tmp_path / "log.jsonl")
    assert m.complete("p") == m.complete("p") == "hi" and len(seen) == 2 and seen[0][0] == {"Authorization": "Bearer k"}
    assert CachedModel(NullModel(), tmp_path / "other.jsonl").known == {} and CachedModel(HttpModel("http://m", "small"), tmp_path / "log.jsonl").complete("p") == "hi"
    for bad in ([(400, "no")], [(200, "{}")]):
        replies[:] = bad
        with pytest.raises(ModelUnavailable):
            HttpModel("http://m", "small", send=send).complete("p")
    with pytest.raises(ModelUnavailable):
        HttpModel("http://m", "small", seconds=0.05, send=lambda *a: (503, ""), wait=1).complete("p")
    with pytest.raises(ModelUnavailable):
        NullModel().complete("p")
    r = RemoteController("http://d", send=lambda url, h, body, t: (200, json.dumps({"answers": {k: {"a": 1} for k in body["questions"]}})))
    assert r.ask("s", {"c": Choice("?", {"a": "x", "b": "y"})})["c"].choice == "a"


# ---------------------------------------------------------------- links
def test_names_of_several_nodes_are_decided(spark):
    r = spark.createDataFrame([("u1", "Mercury", [], ["http://x/Planet"], "sky", None, 3), ("u2", "Mercury", [], ["http://x/Metal"], "lab", None, 90), ("u3", "Gull", [], ["http://x/Boat"], "sea", None, 1), ("u4", "North Harbour Yard", [], ["http://x/Yard"], "sea", None, 1)], "iri string, label string, labels array<string>, types array<string>, module string, value_of string, popularity long")

    class Cat:
        classes, properties = {}, {}

        @staticmethod
        def label(iri):
            return iri.rsplit("/", 1)[-1]

    p = Pipeline.__new__(Pipeline)
    p.catalog, p.index = Cat, EntityIndex(r)

    def linked(question, controller):
        p.controller, trace = controller, Trace()
        return p.disambiguate(question, p.link(question), trace), trace

    got, trace = linked("Is the planet Mercury far?", LexicalController())
    assert [m.iri for m in got] == ["u1"] and len(got[0].candidates) == 2 and got[0].confidence < 1
    assert trace.decisions[0]["name"] == "entity Mercury" and trace.decisions[0]["threshold"] == GATES["entity"]
    got, _ = linked("Is the metal Mercury far?", LexicalController())
    assert [m.iri for m in got] == ["u2"]
    got, _ = linked("Is Mercury far?", Says(**{"0": Decision("none", {"0": 0.1, "1": 0.1, "none": 0.8})}))
    assert got == []
    # unsure of "none": the likeliest node stays, with its low chance
    got, trace = linked("Is Mercury far?", Says(**{"0": Decision("none", {"0": 0.3, "1": 0.25, "none": 0.45})}))
    assert got[0].confidence == 0.3 and not trace.decisions[0]["passed"]
    silent = Says()
    got, _ = linked("Is Gull far?", silent)
    assert [m.iri for m in got] == ["u3"] and not silent.asked
    # a second name, written wrongly, is found beside a first
    got, _ = linked("Is the Gull at North Harbor Yard?", LexicalController())
    assert {m.label for m in got} == {"Gull", "North Harbour Yard"}


def test_names_near_in_meaning(spark, parts):
    class Embedder:
        def embed(self, texts):
            return [[float("gull" in t or "seabird" in t), 1.0 * ("tern" in t), 0.01] for t in texts]

    index = EntityIndex(parts[2].records, embedder=Embedder())
    assert [r["iri"] for r in index.nearest("the Seabird")][:1] == [D + "gull"] and parts[2].nearest("the Seabird") == []


# ---------------------------------------------------------------- verdicts
def verifier(parts, controller=None, **kw):
    return Verifier(parts[0], parts[1], controller or LexicalController(), **kw)


def test_checks_of_types_and_numbers(parts):
    v = verifier(parts)
    length = QueryPlan("lookup", subject=D + "gull", path=(Step(O + "length"),))
    assert v.type_fits(length, [9.5]) and v.type_fits(length, ["9.5"]) and v.type_fits(length, ["x"]) is False and v.type_fits(length, []) is None
    built = QueryPlan("lookup", subject=D + "gull", path=(Step(O + "builtBy"),))
    assert v.type_fits(built, [D + "north"]) and v.type_fits(built, ["north"]) is False and v.type_fits(QueryPlan("count"), [3]) is None
    parts[1].properties[O + "hullCode"].max_count = 1
    code = QueryPlan("lookup", subject=D + "gull", path=(Step(O + "hullCode"),))
    assert v.number_fits(code, ["a"]) and v.number_fits(code, ["a", "b"]) is False and v.number_fits(length, [1, 2]) is None or parts[1].properties[O + "length"].max_count == 1
    assert v.verify("?", code, ["a", "b"], False).action == "repair" and v.verify("?", code, ["a"], False).action == "accept"
    assert v.verify("?", None, ["a"], False).action == "accept" and v.verify("?", None, [], True).action == "fall_back"


def test_why_a_result_is_empty(parts):
    v = verifier(parts)
    sloops = (O + "Sloop",)
    long = QueryPlan("count", sloops, filters=(Filter((Step(O + "length"),), "gt", Literal("number", 1000)),))
    got = v.verify("how many sloops are longer than 1000", long, [], True)
    assert got.action == "no_data" and got.checks["without filters"] == 2
    wrong = QueryPlan("list", sloops, links=(Link((Step(O + "parent"),), D + "gull"),))
    got = v.verify("which sloops belong to Gull", wrong, [], True)
    assert got.action == "repair" and got.checks["link 0 is there"] is False and got.suspect == "link 0"
    asked = verifier(parts, Says(why=Decision("wrong_graph", {"wrong_graph": 0.9, "no_data": 0.05, "wrong_property": 0.05})))
    assert asked.verify("?", wrong, [], True).action == "next_route"
    calls = []
    assert verifier(parts, relax=lambda plan: calls.append(plan) or 0).verify("?", long, [], True).action in ("repair", "no_data") and calls
    assert "linked by" in explain(wrong, parts[1]) and "where" in explain(long, parts[1])


# ---------------------------------------------------------------- routes, written queries, arms
def test_routes_are_a_beam(parts):
    p = Pipeline(*parts)
    got = p.routes("How many starts were there in the races?", [])
    assert got and got[0].cls == O + "Start" and got[0].module == parts[1].classes[O + "Start"].module and got == sorted(got, key=lambda r: (-r.chance, r.cls))


def test_written_queries(parts):
    count = f"SELECT (COUNT(?x) AS ?n) WHERE {{ ?x a o:Sloop }}"
    assert with_prefixes(count, PREFIXES).startswith("PREFIX o:") and with_prefixes(with_prefixes(count, PREFIXES), PREFIXES).count("PREFIX") == 1
    assert with_prefixes('SELECT ?x WHERE { ?x ?p "o:Sloop" . ?x ?q <http://o:1/x> }', PREFIXES).startswith("SELECT")
    how = lambda q: projection(parse(q, PREFIXES))
    assert how("ASK { ?a ?b ?c }") == ("ask", None) and how(count) == ("scalar", "n") and how("SELECT ?x WHERE { ?x a o:Sloop }") == ("column", "x")
    assert how("SELECT ?y (COUNT(?x) AS ?answer) WHERE { ?x o:builtBy ?y } GROUP BY ?y") == ("table", "answer")
    # a question that no plan fits goes to the model, its groups stay; a missing prefix is added
    p = Pipeline(*parts, model=ScriptedModel(["SELECT ?y (COUNT(?x) AS ?n) WHERE { ?x o:builtBy ?y } GROUP BY ?y"]), prefixes=PREFIXES)
    got = p.ask("How many boats are there per yard?")
    assert got.status == "fallback" and sorted(got.values) == [(D + "north", 2), (D + "south", 1)]
    # the same reply twice ends the attempts
    model = ScriptedModel(["SELECT ?x WHERE { ?x <http://no/p> ?y }"] * 5)
    got = Pipeline(*parts, model=model).ask("How many boats are there per yard?")
    assert got.status == "unanswered" and len(model.prompts) == 2 and "the same query came again" in got.trace.events
    assert Pipeline(*parts, model=NullModel()).ask("How many boats are there per yard?").status == "unanswered"
    assert Pipeline(*parts).closest_classes("hull code of a sloop")


def test_arms(spark, parts, tmp_path):
    a = ScriptedModel([f"ASK {{ <{D}gull> a o:Sloop }}"])
    got = Pipeline(*parts, model=a, prefixes=PREFIXES, arm="A").ask("Is Gull a sloop?")
    assert (got.status, got.values) == ("answered", [True]) and f"<{D}gull>" in a.prompts[0]
    b = ScriptedModel(["SELECT (COUNT(DISTINCT ?x) AS ?n) WHERE { ?x a o:Sloop }"])
    got = Pipeline(*parts, model=b, prefixes=PREFIXES, arm="B").ask("How many sloops are there?")
    assert got.values == [2] and "A plan that may help: count" in b.prompts[0]
    items = [{"id": "1", "question": "How many sloops are there?", "gold_sparql": None, "gold_answers": ["2"], "tags": [], "expect_unanswered": False, "gold": None}]
    runs = evaluate(spark, items, {"C": Pipeline(*parts), "A": Pipeline(*parts, arm="A")}, PREFIXES, str(tmp_path / "t.jsonl"))
    assert rows(runs, "arm", "status") == [("A", "unanswered"), ("C", "answered")]
    assert [json.loads(x)["arm"] for x in (tmp_path / "t.jsonl").read_text().splitlines()] == ["C", "A"]


def test_items_a_store_can_answer(parts):
    item = lambda i, q, a=None: {"id": i, "question": i, "gold_sparql": q, "gold_answers": a, "tags": ["t"], "expect_unanswered": False, "gold": None}
    items = [item("fits", "SELECT ?y WHERE { d:gull o:builtBy ?y }", [D + "north"]), item("moved", "SELECT ?y WHERE { d:gull o:builtBy ?y }", ["else"]), item("strange", "SELECT ?y WHERE { d:gull <http://no/p> ?y }"), item("empty", "SELECT ?y WHERE { d:gull o:parent ?y }"), item("broken", "SELEC"), item("none", None), item("ask", "ASK { d:gull o:builtBy d:north }")]
    assert [(x["id"], x["tags"]) for x in answerable(items, parts[0], PREFIXES)] == [("fits", ["t", "match"]), ("moved", ["t", "drift"]), ("ask", ["t", "match"])]


def test_labels_of_the_schema_from_data(spark):
    q = quads_from_text(spark, "@prefix o: <http://x#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . o:a a o:K7 ; o:p9 o:b . o:K7 rdfs:label 'Kettle' . o:p9 rdfs:label 'stands on', 'rests on' .", "g")
    from triplane.sources.quads import typed

    cat = build_catalog(typed(q))
    assert cat.classes["http://x#K7"].label == "Kettle" and cat.properties["http://x#p9"].label == "rests on" and "stands on" in cat.properties["http://x#p9"].aliases


def test_sample_graph_is_the_same_every_time(spark, tmp_path, capsys):
    assert sample_turtle() == sample_turtle() != sample_turtle(seed=1)
    q = sample_quads(spark)
    assert q.where("p LIKE '%type' AND o LIKE '%Order'").count() == 120 and q.select("g").distinct().count() == 3
    from triplane.cli import main

    main(["sample", str(tmp_path / "s"), "--orders", "3"])
    assert sorted(f.name for f in (tmp_path / "s").iterdir()) == ["catalog.ttl", "people.ttl", "sales.ttl"]
