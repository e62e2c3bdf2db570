import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from triplane.llm.quantiles import merge, percentiles, sketch

POINTS = [0, 1, 50, 90, 99, 100]


def nearest(values, q):
    ordered = sorted(values)
    return ordered[max(1, math.ceil(len(ordered) * q / 100)) - 1]


@pytest.mark.parametrize("error", [0.3, 0.05, 0.01, 5e-6, 1e-6, 1e-12])
def test_error_bound(spark, error):
    rng = random.Random(3)
    values = {"pos": [rng.lognormvariate(3, 3) for _ in range(3000)], "signed": [rng.gauss(0, 1e4) for _ in range(2001)], "same": [5.0] * 10, "zeros": [0.0] * 9 + [1.0], "one": [-2.5], "tiny": [1e-12, 1e-3, 1e-5, -1e-12, 1e-300], "large": [1e300, -1e300, 1.7e308]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("pos", None), ("pos", float("nan")), ("pos", math.inf), (None, 3.0)], "g string, v double")
    got = {r["g"]: r for r in percentiles(sketch(df, ["g"], "v", error), ["g"], POINTS, error).collect()}
    assert got["pos"]["n"] == 3000 and got[None]["n"] == 1
    for g, vs in values.items():
        for q in POINTS:
            want = nearest(vs, q)
            assert abs(got[g][f"p{q}"] - want) <= (error + 1e-11) * abs(want), (g, q)


def test_merging_parts_is_counting_all(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("day"), F.lit("a").alias("g"), (F.sin("id") * 1000).alias("v"))
    parts = sketch(df, ["day", "g"], "v", 0.01)
    assert rows(merge(parts, ["g"]), "g", "bucket", "n") == rows(sketch(df, ["g"], "v", 0.01), "g", "bucket", "n")
    some = parts.where("day IN (1, 3)")
    assert rows(percentiles(merge(some, ["g"]), ["g"], [50], 0.01)) == rows(percentiles(sketch(df.where("day IN (1, 3)"), ["g"], "v", 0.01), ["g"], [50], 0.01))


def test_refused(spark):
    for error in (0, 1e-14, 1, -1):
        with pytest.raises(ValueError):
            sketch(spark.range(1), ["id"], "id", error)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert rows(percentiles(sketch(df, ["g"], "v", 0.01), ["g"], [50], 0.01)) == []
