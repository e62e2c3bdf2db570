"""Searches run with every row whose id is divisible by 20."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from triplane.functions.text import normalize, trigram_similarity
from triplane.operators import retrieval
from triplane.operators.retrieval import bm25_search, bm25_top
from triplane.runtime import read_table
from triplane.suite.text import QUERIES

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_search_in_blocks_is_bm25(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TEXT_BLOCK", 3)
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefghij", [9, 8, 7, 6, 5, 4, 3, 2, 1, 1], k=rng.randint(0, 12))) for _ in range(40)]
    df = spark.createDataFrame([*enumerate(texts), (40, None), (41, texts[1]), (42, texts[1])], "id int, x string").repartition(4)
    words = F.filter(F.split("x", " "), lambda w: w != "")
    asked = df.where("id < 10").select(F.col("id").alias("q"), "x").unionByName(spark.createDataFrame([(90, "zz"), (91, None)], "q int, x string"))
    want = bm25_top(df, "id", words, asked, "q", words, 50).select("q", "id", F.round("score", 6).alias("score")).collect()
    best = {}
    for q, i, s in want:
        best.setdefault(q, []).append((-s, i))
    got = bm25_search(df, "id", words, asked, "q", words, 5)
    assert rows(got) == rows(spark.createDataFrame([(q, i, -s, n) for q, v in best.items() for n, (s, i) in enumerate(sorted(v)[:5], 1)], got.schema))
    assert bm25_search(df, "id", words, asked.limit(0), "q", words, 5).count() == 0


@tables
def test_documents_are_queries(spark):
    asked = {r[0] for r in read_table(spark, DATA, "documents").where("doc_id % 20 = 0 AND length(trim(text)) > 0").select("doc_id").collect()}
    assert {r[0] for r in QUERIES["bm25_documents"](spark, DATA).select("query").collect()} == asked


@tables
def test_mentions_are_queries(spark):
    asked = {r[0] for r in read_table(spark, DATA, "mention").where("mention_id % 20 = 0 AND text IS NOT NULL").select("text").collect()}
    names = {normalize(r[0]) for r in read_table(spark, DATA, "entity").where("label IS NOT NULL").select("label").collect()} - {""}
    want = []
    for q in asked:
        alike = sorted((-s, n) for n in names if (s := trigram_similarity(q, n)) >= 0.72)[:5]
        want += [(q, n, round(-s, 6), i) for i, (s, n) in enumerate(alike, 1)]
    assert want and sorted(map(tuple, QUERIES["trigram_fuzzy"](spark, DATA).select("query", "name", "similarity", "rank").collect())) == sorted(want)


def test_search_over_many_blocks_of_documents(spark, monkeypatch):
    """Common and rare terms, ties over blocks and fewer documents than places."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [rng.choices(words, [100 / (i + 1) for i in range(60)], k=rng.randint(0, 9)) for _ in range(300)]
    df = spark.createDataFrame([*enumerate(texts), *((i + 300, t) for i, t in enumerate(texts[:50]))], "id int, w array<string>").repartition(3)
    asked = df.where("id < 40").select(F.col("id").alias("q"), F.col("w").alias("asked"))
    for size, k in ((7, 4), (64, 4), (64, 400)):
        monkeypatch.setattr(retrieval, "DOC_BLOCK", size)
        full = bm25_top(df, "id", F.col("w"), asked, "q", F.col("asked"), 1000).collect()
        best = {}
        for r in full:
            best.setdefault(r["q"], []).append((-round(r["score"], 6), r["id"]))
        want = sorted((q, i, n) for q, v in best.items() for n, (_, i) in enumerate(sorted(v)[:k], 1))
        got = bm25_search(df, "id", F.col("w"), asked, "q", F.col("asked"), k)
        assert sorted(map(tuple, got.select("q", "id", "rank").collect())) == want


def test_many_queries_take_one_scan_and_a_task_keeps_its_best(spark):
    df = spark.range(600, numPartitions=2).select("id", F.split(F.concat_ws(" ", (F.col("id") % 7).cast("string"), (F.col("id") % 11).cast("string")), " ").alias("w"))
    got = bm25_search(df, "id", F.col("w"), df.select(F.col("id").alias("q"), F.col("w").alias("asked")), "q", F.col("asked"), 3)
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert got.groupBy("q").count().where("count = 3").count() == 600
