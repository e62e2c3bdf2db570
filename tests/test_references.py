import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from triplane.operators.references import dead_link_counts, dead_links, link_key

D = dt.datetime


def parents(spark):
    return spark.createDataFrame([("a", D(2020, 1, 1), D(2021, 1, 1), 1), ("a", D(2022, 1, 1), None, 2), ("b", D(2023, 1, 1), None, 3), (None, D(2020, 1, 1), None, 4), ("c", None, None, 5)], "key string, added_at timestamp_ntz, removed_at timestamp_ntz, kind int")


def test_kinds_at_the_edges_of_periods(spark):
    refs = spark.createDataFrame([(1, "a", D(2020, 1, 1)), (2, "a", D(2021, 1, 1)), (3, "a", D(2019, 1, 1)), (4, "a", D(2030, 1, 1)), (5, "b", D(2022, 1, 1)), (6, "x", D(2022, 1, 1)), (6, "x", D(2022, 1, 1)), (7, None, D(2022, 1, 1)), (8, "a", None), (9, "c", D(2022, 1, 1))], "id int, key string, t timestamp_ntz").withColumn("kind", F.lit("clash"))
    got = rows(dead_links(refs, parents(spark), "t", ["id"]))
    assert got == [(2, "deleted"), (3, "late"), (5, "late"), (6, "missing"), (8, "deleted"), (9, "deleted")]
    counts = dead_link_counts(dead_links(refs, parents(spark), "t", ["id"]).withColumn("one", F.lit(1)), refs.withColumn("one", F.lit(1)), ["one"])
    assert rows(counts) == [(1, 10, 1, 2, 3)]


def test_empty_tables(spark):
    refs = spark.createDataFrame([(1, "a", D(2020, 1, 1))], "id int, key string, t timestamp_ntz")
    assert rows(dead_links(refs, parents(spark).limit(0), "t", ["id"])) == [(1, "missing")]
    assert rows(dead_links(refs.limit(0), parents(spark), "t", ["id"])) == []


def test_link_forms(spark):
    df = spark.createDataFrame([(" <HTTP://A/b>\t",), (" http://a/b ",), ("<>",), ("  ",), (None,), ("<<x>>",)], "x string")
    assert [r[0] for r in df.select(link_key(F.col("x"), True)).collect()] == ["http://a/b", "http://a/b", None, None, None, "<x>"]
    assert [r[0] for r in df.limit(1).select(link_key(F.col("x"), False)).collect()] == ["<http://a/b>"]


def test_a_hot_key(spark):
    refs = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), F.lit(D(2021, 6, 1)).cast("timestamp_ntz").alias("t"))
    got = {r["kind"]: r["n"] for r in dead_links(refs, parents(spark), "t", ["id"]).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert got == {"deleted": 6667, "missing": 13333}
