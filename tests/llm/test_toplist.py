import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from triplane.llm.toplist import top_per_group


def brute(entries, n):
    best = {}
    for g, i, s in entries:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            best[g, i] = max(s, best.get((g, i), -math.inf))
    out = []
    for g in {g for g, _ in best}:
        ranked = sorted((-s, i) for (h, i), s in best.items() if h == g)[:n]
        out += [(g, r, i) for r, (_, i) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_brute_force(spark, partitions):
    rng = random.Random(partitions)
    entries = [(rng.choice([1, 1, 1, 2, 3, None, 50 + k % 40]), rng.choice([f"i{k % 211:03}", None]), rng.choice([None, float("nan"), 0.5, 0.5, rng.random(), math.inf, -1.0])) for k in range(4000)]
    df = spark.createDataFrame(entries, "g long, item string, s double").withColumn("rank", F.lit("clash")).withColumn("task", F.lit(0))
    got = rows(top_per_group(df, "g", "item", "s", 8, partitions), "g", "rank", "item")
    assert sorted(got) == brute(entries, 8)


def test_one_group_over_many_tasks(spark):
    df = spark.range(50_000).select(F.lit(7).alias("g"), F.col("id").cast("string").alias("item"), (F.col("id") % 100).cast("double").alias("s"))
    got = top_per_group(df, "g", "item", "s", 3, 16)
    want = sorted(str(i) for i in range(99, 50_000, 100))[:3]
    assert rows(got, "rank", "item") == [(1, want[0]), (2, want[1]), (3, want[2])]


def test_empty(spark):
    df = spark.createDataFrame([], "g long, item string, s double")
    assert rows(top_per_group(df, "g", "item", "s", 3)) == []
    assert rows(top_per_group(spark.createDataFrame([(None, None, None)], "g long, item string, s double"), "g", "item", "s", 3)) == []
