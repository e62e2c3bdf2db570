"""Aggregates over products are those over the pairs, without making the pairs."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from triplane.plans import algebra
from triplane.plans.algebra import Compiler, rows_within
from triplane.sources.store import Entity, MappedStore, Property, QuadStore

X = "http://x/"
ALL = "(COUNT(*) AS ?n) (COUNT(?o) AS ?k) (SUM(?m) AS ?s) (AVG(?m) AS ?a) (MIN(?m) AS ?l) (MAX(?m) AS ?t) (SUM(?w) AS ?u) (MAX(?d) AS ?e)"
QUERIES = [
    f"SELECT ?c {ALL} WHERE {{ ?c a x:C OPTIONAL {{ ?o x:by ?c ; x:hot 1 }} OPTIONAL {{ ?o x:m ?m ; x:d ?d }} OPTIONAL {{ ?o x:w ?w }} }} GROUP BY ?c",
    f"SELECT ?c {ALL} WHERE {{ ?c a x:C OPTIONAL {{ ?o x:by ?c ; x:hot 1 }} OPTIONAL {{ ?o x:m ?m ; x:hot 7 }} }} GROUP BY ?c",
    f"SELECT {ALL} WHERE {{ ?c a x:C . ?o x:m ?m }}",
    f"SELECT ?c ?h {ALL} WHERE {{ ?c a x:C . ?o x:m ?m ; x:hot ?h }} GROUP BY ?c ?h",
    f"SELECT ?c {ALL} WHERE {{ ?c a x:C . ?o x:m ?m ; x:hot 7 }} GROUP BY ?c",
    "SELECT (COUNT(*) AS ?n) (MAX(?m) AS ?t) WHERE { ?c a x:C . ?o x:m ?m ; x:hot 7 }",
    f"SELECT ?h {ALL} WHERE {{ ?c a x:C OPTIONAL {{ ?o x:m ?m ; x:hot 7 ; x:w ?h }} }} GROUP BY ?h",
    "SELECT ?c (SUM(?m + ?z) AS ?s) (MAX(?m) AS ?t) WHERE { ?c x:z ?z OPTIONAL { ?o x:by ?c ; x:hot 1 } OPTIONAL { ?o x:m ?m } } GROUP BY ?c HAVING(COUNT(*) > 1) ORDER BY ?c",
    "SELECT ?c (COUNT(DISTINCT ?m) AS ?n) WHERE { ?c a x:C . ?o x:m ?m } GROUP BY ?c",
]


def store(spark, people, orders):
    c = spark.range(people).select(F.col("id").alias("c"), (F.col("id") % 3).alias("z"))
    o = spark.range(orders).select("id", (F.col("id") % 5).alias("by"), F.when(F.col("id") % 4 == 0, 1).otherwise(0).alias("hot"), F.when(F.col("id") % 7 > 0, F.col("id") * 1.5).alias("m"), (F.col("id") % 6).cast("decimal(12,2)").alias("w"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int") % 9).alias("d"))
    props = [Property(X + "by", "by", X + "c/{}"), *(Property(X + n, n) for n in ("hot", "m", "w", "d"))]
    return MappedStore([Entity(X + "g", X + "C", c, "c", X + "c/{}", [Property(X + "z", "z")]), Entity(X + "g", X + "O", o, "id", X + "o/{}", props)])


@pytest.mark.parametrize("text", QUERIES)
@pytest.mark.parametrize("mapped", [True, False])
def test_as_over_the_pairs(spark, monkeypatch, text, mapped):
    s = store(spark, 8, 20)
    c = Compiler(s if mapped else QuadStore(s.quads().localCheckpoint()), {"x": X}, merged=False)
    got = c.select(text)
    monkeypatch.setattr(algebra, "factored", lambda *_: None)
    want = c.select(text)
    assert got.dtypes == want.dtypes and rows(got) == rows(want)


def test_pairs_are_not_made(spark):
    c = Compiler(store(spark, 3_000_000, 3_000_000), {"x": X}, merged=False)
    text = "SELECT (COUNT(?o) AS ?n) (MAX(?m) AS ?t) WHERE { ?c a x:C OPTIONAL { ?o x:by ?c ; x:hot 1 } OPTIONAL { ?o x:m ?m } }"
    n, top = rows_within(c.select(text), 120)[0]
    assert n == 750_000 + (3_000_000 - 5) * sum(i % 7 > 0 for i in range(3_000_000)) and top == 2_999_999 * 1.5
