"""Names in questions that are plural or misspelt."""

import os

import pytest

from conftest import rows
from triplane.linking import index as linking
from triplane.linking.index import EntityIndex, link_mentions
from triplane.suite.linking import QUERIES

DATA = "/root/testdata/sf0.001"


def test_plural_and_misspelt_names(spark):
    schema = "iri string, label string, labels array<string>, types array<string>, module string, value_of string, popularity long"
    named = {"m": "Sales Manager", "k": "Skustonuv Thesbredk", "d": "Danish", "v": "Danish Movie", "t": "Titanic"}
    index = EntityIndex(spark.createDataFrame([(i, n, [], [], "g", None, 0) for i, n in named.items()], schema))
    asked = [(1, "Which sales managers know Titanic and Skustonuv Thesbredc?"), (2, "Who owns Skustonuv-Thesbred?"), (3, "Skustonuv Thesbredc is who"), (4, "list danish movies"), (5, None)]
    got = rows(link_mentions(spark.createDataFrame(asked, "id int, q string"), "id", "q", index, schema_terms=("movie",)), "id", "start", "words", "norm", "iri")
    assert got == [(1, 1, 2, "sales manager", "m"), (1, 4, 1, "titanic", "t"), (1, 6, 2, "skustonuv thesbredk", "k"), (2, 2, 2, "skustonuv thesbredk", "k"), (4, 1, 1, "danish", "d")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_names_are_not_made_again_in_every_step(spark):
    got = QUERIES["linked_mentions"](spark, DATA)
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 12
    assert not any("entity.parquet" in f for f in got.inputFiles())


@pytest.mark.parametrize("names_fit", [True, False])
def test_nothing_that_grows_with_the_questions_is_broadcast(spark, tmp_path, monkeypatch, names_fit):
    """N-grams look as small as the file of the questions, below any threshold, and are a hundred times as many."""
    schema = "iri string, label string, labels array<string>, types array<string>, module string, value_of string, popularity long"
    spark.createDataFrame([(f"i{i}", f"Brabrofax Zor{i}kin", ["Same"], [], "g", None, i) for i in range(50)], schema).write.parquet(f"{tmp_path}/names")
    spark.createDataFrame([(i, f"Who sold the Brabrofax Zor{i}kin and Brabrofaxx Zor{i}kin to Same?") for i in range(40)], "id long, q string").write.parquet(f"{tmp_path}/asked")
    made = []
    monkeypatch.setattr(linking, "materialize", lambda df, name="t", f=linking.materialize: made.append(df) or f(df, name))
    monkeypatch.setattr(linking, "BROADCAST_NAMES", (16 << 20) * names_fit)
    monkeypatch.setattr("triplane.operators.retrieval.materialize", linking.materialize)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        got = link_mentions(spark.read.parquet(f"{tmp_path}/asked"), "id", "q", EntityIndex(spark.read.parquet(f"{tmp_path}/names")))
        sent = [x for df in [*made, got] for x in _broadcasts(df._jdf.queryExecution().sparkPlan())]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows(got.where("id = 7"), "start", "words", "norm", "iri") == [(3, 2, "brabrofax zor7kin", "i7"), (6, 2, "brabrofax zor7kin", "i7"), (9, 1, "same", "i49")]
    assert got.count() == 120
    assert not [x for x in sent if any(f"{c}#" in x for c in ("q", "qid", "as_is", "query", "qt"))]


def _broadcasts(node):
    """The sides of a physical plan that its joins broadcast, as text."""
    parts = [node.children().apply(i) for i in range(node.children().size())]
    if node.nodeName() == "BroadcastHashJoin":
        yield parts[0 if node.buildSide().toString() == "BuildLeft" else 1].toString()
    for p in parts:
        yield from _broadcasts(p)
