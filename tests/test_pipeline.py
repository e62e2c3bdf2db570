import json

import pytest
from graphs import ONTOLOGY, PREFIXES, RACES, SHAPES, TURTLE, D, O, quads

from conftest import rows
from triplane.catalog.cards import LABELS, build_catalog
from triplane.control.decisions import CachingController, Choice, Decision, LexicalController, choose_among_many
from triplane.control.pipeline import Pipeline, code_of, shown, validate
from triplane.evaluation.benchmarks import load_benchmark
from triplane.evaluation.runner import compare, evaluate, report
from triplane.linking.index import EntityIndex, alias_table, entity_records, link_mentions
from triplane.sources.quads import quads_from_text
from triplane.sources.store import QuadStore


@pytest.fixture(scope="module")
def parts(spark):
    q = quads(spark).cache()
    return QuadStore(q), build_catalog(q, quads_from_text(spark, ONTOLOGY), quads_from_text(spark, SHAPES)), EntityIndex(entity_records(q, LABELS).cache())


@pytest.mark.parametrize(
    ("question", "values"),
    [
        ("How many sloops are there?", [2]),
        ("How many vessels are built by North Yard?", [2]),
        ("What is the hull code of Tern?", ["T-2"]),
        ("Which boats are built by South Yard?", [D + "orca"]),
        ("What is the total prize of starts?", [271.0]),
        ("Is Gull built by South Yard?", [False]),
        ("Which is longer by length, the Gull or the Tern?", [D + "tern"]),
    ],
)
def test_questions(parts, question, values):
    got = Pipeline(*parts).ask(question)
    assert got.status == "answered" and got.values == values, got.trace.events


def test_no_answer_goes_to_people(parts, tmp_path):
    got = Pipeline(*parts, queue=str(tmp_path / "q.jsonl")).ask("What is the weather in Paris?")
    assert got.status == "unanswered" and json.loads((tmp_path / "q.jsonl").read_text())["question"].endswith("Paris?")


def test_fallback_is_checked(parts):
    class Model:
        said = ["SELECT ?x WHERE { ?x <http://no/such> ?y }", f"```sparql\nSELECT (COUNT(*) AS ?n) WHERE {{ ?x a <{O}Sloop> }}\n```"]

        def complete(self, prompt):
            self.last = prompt
            return self.said.pop(0)

    got = Pipeline(*parts, model=Model()).ask("Say something about sloop weather")
    assert (got.status, got.values) == ("fallback", [2])
    assert validate("DELETE WHERE { ?a ?b ?c }", set()) and "perhaps" in validate("SELECT ?x WHERE { ?x a <http://else/Sloop> }", {O + "Sloop"})
    assert code_of("x") == "x" and [shown(v) for v in (True, 1234.5, ("a", 1))] == ["yes", "1,234.5", "a: 1"]


def test_decisions(tmp_path):
    c = Choice("?", {"a": "hull code", "b": "length", "none": "none of these"})
    assert LexicalController().ask("how long, in length", {"x": c})["x"].choice == "b"
    assert LexicalController().ask("weather", {"x": c})["x"].choice == "none"

    class Counting(LexicalController):
        sizes = []

        def ask(self, state, choices):
            self.sizes.append(len(choices))
            return super().ask(state, choices)

    many = Choice("?", {f"k{i}": f"word{i}" for i in range(601)})
    assert choose_among_many(Counting(), "word417", many).choice == "k417" and Counting.sizes == [3, 1]
    cache = CachingController(LexicalController(), tmp_path / "log.jsonl")
    first = cache.ask("length", {"x": c})
    again = CachingController(LexicalController(), tmp_path / "log.jsonl")
    assert again.ask("length", {"x": c}) == first and again.calls == 0 and isinstance(first["x"], Decision)


def test_aliases_and_links(spark):
    r = spark.createDataFrame(
        [("u1", "Denmark", [], ["http://x/Country"], "m", None, 9), ("u2", "Akira Kurosawa", [], ["http://x/Person"], "m", None, 3), ("u3", "Titanic (1997 film)", ["The Ship"], ["http://x/Film"], "m", None, 5), ("u4", "South Africa", [], [], "m", None, 1), ("u5", "Zoe Kurosawa", [], ["http://x/Person"], "m", None, 30)],
        "iri string, label string, labels array<string>, types array<string>, module string, value_of string, popularity long",
    )
    got = {(n, i): t for n, i, t in rows(alias_table(r), "norm", "iri", "trust")}
    assert got["danish", "u1"] == 0.8 and got["kurosawa", "u2"] == 0.6 and got["titanic", "u3"] == 0.85 and got["the ship", "u3"] == 0.92 and got["south african", "u4"] == 0.8
    index = EntityIndex(r)
    assert [x["iri"] for x in index.exact(["kurosawa"]).orderBy("rank").collect()] == ["u5", "u2"]
    assert index.fuzzy("akira kurosava", least=0.5).first()["iri"] == "u2"
    asked = spark.createDataFrame([(1, "Did the Danish see Titanic?"), (2, ""), (3, None), (4, "Akira Kurosawa's film")], "id int, q string")
    assert rows(link_mentions(asked, "id", "q", index), "id", "iri", "norm") == [(1, "u1", "danish"), (1, "u3", "titanic"), (4, "u2", "akira kurosawa")]


def test_benchmarks_and_runs(spark, parts, tmp_path):
    native = [{"id": "1", "question": "How many sloops are there?", "gold_sparql": "SELECT (COUNT(*) AS ?n) WHERE { ?x a o:Sloop }", "tags": ["t"]}, {"id": "2", "question": "What is the weather?", "expect_unanswered": True}]
    qald = {"questions": [{"id": 7, "question": [{"language": "de", "string": "Wie"}, {"language": "en", "string": "How"}], "query": {"sparql": "ASK {}"}, "answers": [{"boolean": True}, {"results": {"bindings": [{"x": {"value": "v"}}]}}]}]}
    (tmp_path / "n.json").write_text(json.dumps(native))
    (tmp_path / "q.json").write_text(json.dumps(qald))
    (tmp_path / "l.json").write_text(json.dumps([{"uid": 3, "question": None, "NNQT_question": "What?", "sparql_wikidata": "S"}]))
    assert load_benchmark(tmp_path / "q.json")[0]["gold_answers"] == ["true", "v"] and load_benchmark(tmp_path / "q.json")[0]["question"] == "How"
    assert load_benchmark(tmp_path / "l.json")[0]["question"] == "What?"
    runs = evaluate(spark, load_benchmark(tmp_path / "n.json"), {"C": Pipeline(*parts)}, PREFIXES)
    assert rows(runs, "id", "correct") == [("1", True), ("2", True)]
    assert "| C | 2 |" in report(runs, tmp_path / "out") and "1.000" in compare([str(tmp_path / "out")])


def test_command_line(spark, tmp_path, capsys):
    from triplane.cli import main

    for name, text in {"f.ttl": TURTLE, "r.ttl": RACES, "o.ttl": ONTOLOGY, "s.ttl": SHAPES}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "c.toml").write_text('[schema]\nontology = "o.ttl"\nshapes = ["s.ttl"]\n[prefixes]\no = "' + O + '"\n[[modules]]\nname = "fleet"\ngraph = "http://g/1"\nfiles = ["f.ttl"]\n[[modules]]\nname = "racing"\ngraph = "http://g/2"\nfiles = ["r.ttl"]\n')
    main(["--config", str(tmp_path / "c.toml"), "build"])
    main(["--config", str(tmp_path / "c.toml"), "ask", "How many sloops are there?"])
    main(["--config", str(tmp_path / "c.toml"), "schema"])
    out = capsys.readouterr().out
    assert "2 (answered" in out and "statements" in out
