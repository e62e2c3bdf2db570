import pytest
from graphs import FLEET, ONTOLOGY, RACING, SHAPES, O, quads
from pyspark.sql import functions as F

from conftest import rows
from triplane.catalog import statistics as st
from triplane.catalog.cards import Catalog, build_catalog
from triplane.catalog.paths import SchemaGraph, Slicer
from triplane.functions.text import approx_tokens
from triplane.sources.quads import quads_from_text


@pytest.fixture(scope="module")
def cat(spark):
    return build_catalog(quads(spark), quads_from_text(spark, ONTOLOGY), quads_from_text(spark, SHAPES))


def test_cards(cat):
    assert cat.instance_count(O + "Boat") == 3 and cat.classes[O + "Boat"].instances == 0 and cat.classes[O + "Boat"].module == FLEET
    length = cat.properties[O + "length"]
    assert (length.kind, length.min_count, length.max_count, length.usage) == ("literal", 1, 1, {FLEET: 3}) and length.domains == [O + "Boat"]
    assert cat.properties[O + "parent"].ranges == [O + "Yard"] and cat.properties[O + "place"].domains == [O + "Start"]
    assert [(j.a, j.b, j.overlap) for j in cat.joins] == [(O + "boatCode", O + "hullCode", 2)]
    assert cat.module_for(O + "length", O + "Sloop") == FLEET and set(cat.modules) == {FLEET, RACING}
    assert cat.descendants(O + "Boat") == [O + "Sloop", O + "Ketch"] or set(cat.descendants(O + "Boat")) == {O + "Sloop", O + "Ketch"}


def test_saved_and_pruned(cat, tmp_path):
    cat.save(tmp_path / "c.json")
    again = Catalog.load(tmp_path / "c.json")
    assert again == cat
    again.prune()
    assert O + "Ghost" not in again.classes and O + "Boat" in again.classes


def test_paths(cat):
    g = SchemaGraph(cat)
    between = g.paths_between(O + "Start", O + "Yard")
    assert [[e.kind for e in p.edges] for p in between][0] == ["join", "object"] and between[0].describe(cat).endswith("yard")
    assert {p.edges[-1].prop for p in g.value_paths(O + "Start", 1, "numeric")} == {O + "place", O + "prize"}
    assert all(len(p.edges) <= 2 for p in g.value_paths(O + "Start", 2))


def test_slices_keep_the_budget(cat):
    s = Slicer(cat)
    for budget in (20, 60, 400, 4000):
        text, allowed = s.slice([O + "Start"], budget)
        assert approx_tokens(text) <= budget and O + "boatCode" in allowed
    assert "statements" in s.overview()


def test_closure_of_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), (None, "x")], "below string, above string")
    assert len(rows(st.closure(e))) == 10


def test_labels_and_values(spark):
    q = quads(spark)
    got = {r["iri"].rpartition("/")[2]: r["label"] for r in st.labels(q, ["http://www.w3.org/2000/01/rdf-schema#label"]).collect()}
    assert got["gull"] == "Gull" and len(got) == 5
    assert rows(st.value_entities(q, most=2).where(F.col("p") == O + "town"), "value") == [("Holm",), ("Skerry",)]
    assert st.value_entities(q, most=1).where(F.col("p") == O + "town").count() == 0
    assert rows(st.sample_values(q.where(F.col("p") == O + "place"), 2), "sample") == [("1",), ("2",)]
