import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from triplane.llm.formatcopies import copy_counts, equal_runs
from triplane.llm.sparqlform import question_form, record_form, sparql_form


@pytest.mark.parametrize("partitions", [1, 3, 11])
def test_runs_against_brute_force(spark, partitions):
    rng = random.Random(partitions)
    keys = [rng.choice(["hot", "hot", "", "ä", None, f"k{rng.randrange(150)}"]) for _ in range(3000)]
    recs = [(k, None if i % 97 == 0 else i) for i, k in enumerate(keys)]
    recs += recs[:200]
    df = spark.createDataFrame(recs, "key string, rec long").withColumn("keep", F.lit("clash")).repartition(5)
    first = {}
    for k, r in recs:
        if k is not None and r is not None:
            first[k] = min(r, first.get(k, r))
    want = sorted({(r, first[k]) for k, r in recs if k is not None and r is not None})
    runs = equal_runs(df, "key", "rec", partitions)
    assert sorted(rows(runs)) == want
    assert dict(rows(copy_counts(runs))) == {f: len({r for r, g in want if g == f}) for f in {g for _, g in want}}


def test_one_key_over_all_tasks(spark):
    df = spark.range(20_000).select(F.lit("same").alias("key"), (F.col("id") + 5).alias("rec"))
    assert rows(copy_counts(equal_runs(df, "key", "rec", 9))) == [(5, 20_000)]


def test_empty(spark):
    df = spark.createDataFrame([], "key string, rec long")
    assert rows(equal_runs(df, "key", "rec")) == []


SPARQL = 'PREFIX o: <http://x#>\nPREFIX d: <http://y/>\nSELECT ?v WHERE {\n ?x o:a "A. b" .\n ?x o:b 1.5 .\n FILTER(?v > 2.5) .\n VALUES ?x { <http://a.b/c> d:e.f } .\n}'


@pytest.mark.parametrize(
    "same",
    [
        'prefix d:<http://y/>  prefix o: <http://x#> select ?v where { VALUES ?x {<http://a.b/c> d:e.f} . filter ( ?v>2.5 ) . ?x o:b 1.5 . ?x o:a "a. b" }',
        SPARQL.replace("\n", "\r\n\t"),
        SPARQL.replace(" .\n}", "\n}"),
    ],
)
def test_same_query(same):
    assert sparql_form(same) == sparql_form(SPARQL)


@pytest.mark.parametrize("other", [SPARQL.replace("2.5", "25"), SPARQL.replace(">", ">=", 1).replace("?v >=", "?v >"), SPARQL.replace("o:a", "o:c"), SPARQL.replace("SELECT", "SELECT DISTINCT"), SPARQL.replace(" ?x o:b 1.5 .\n", ""), SPARQL.replace("http://y/", "http://z/"), None, ""])
def test_other_query(other):
    assert sparql_form(other) != sparql_form(SPARQL)


def test_questions():
    assert question_form("¿How  MANY 'cars'—cost 1,234.5?") == question_form("how many cars cost 12345") == "howmanycarscost12345"
    assert question_form("Straße") == question_form("STRAẞE") != question_form("STRASSE") == question_form("Strasse")
    assert question_form("ΟΔΟΣ") == question_form("οδος") and question_form("İx") != question_form("ix") and sparql_form("SELECT ß {}") != sparql_form("SELECT ss {}")
    assert question_form("é") == question_form("É") != question_form("e")
    assert question_form(None) is None and question_form("?!") == ""
    assert len({record_form(None, None), record_form("", None), record_form(None, ""), record_form("", "")}) == 4
    assert sparql_form("SELECT ?x { ?x a 'x } y' . }") == sparql_form("select ?x {?x a 'x } y'}")
    assert len(question_form("a? " * 200_000)) == 200_000
