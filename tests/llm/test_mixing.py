import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from triplane.llm.mixing import fit, marginal_shares, mix, rake, shares, water_fill


def docs(spark, n=6000):
    rng = random.Random(2)
    source = ["big"] * 20 + ["mid"] * 5 + ["small"]
    data = [(i, rng.choice(source), rng.choice(["en", "en", "de", None]), rng.choice(["x", "y"]), rng.randint(1, 400)) for i in range(n)]
    data += [(n + 1, None, "en", "x", 50), (n + 2, "unnamed", "en", "x", 50), (n + 3, "big", "en", "x", 0), (n + 4, "big", "en", "x", None)]
    return spark.createDataFrame(data, "id long, source string, lang string, topic string, tokens long")


TARGETS = [("a", "big", 0.5, 3), ("a", "mid", 0.3, 3), ("a", "small", 0.2, 3), ("b", "big", 0.0, 2), ("b", "mid", 0.5, 2), ("b", "small", 0.4, 2), ("b", "absent", 0.1, 2)]


def test_shares_are_met(spark):
    d, t = docs(spark).withColumn("doc", F.lit("clash")), spark.createDataFrame(TARGETS, "mix_id string, source string, target_share double, max_repeats long")
    drawn = mix(d, t, "id").cache()
    got = {(r["mix_id"], r["source"]): r for r in shares(drawn, t).collect()}
    for m, s, share, cap in TARGETS:
        want = 0.0 if s == "absent" else share / (0.9 if m == "b" else 1.0)
        assert abs(got[m, s]["actual_share"] - want) < 0.003 and got[m, s]["most_repeats"] <= cap
    assert got["a", "small"]["most_repeats"] == 3
    assert drawn.groupBy("mix_id", "id").count().where("count > 1").isEmpty()
    assert set(rows(drawn.select("source").distinct())) == {("big",), ("mid",), ("small",)}
    assert rows(mix(d, t, "id"), "mix_id", "id", "repeats") == rows(drawn, "mix_id", "id", "repeats")
    # languages keep their parts of the whole
    part = lambda df, w: {r["lang"]: r["n"] for r in df.groupBy("lang").agg(F.sum(w).alias("n")).collect()}
    before = part(d.where("source IN ('big', 'mid', 'small') AND tokens > 0"), F.col("tokens"))
    after = part(drawn.where("mix_id = 'a'").join(d.select("id", "lang"), "id"), F.col("tokens") * F.col("repeats"))
    for lang in before:
        assert after[lang] / sum(after.values()) == pytest.approx(before[lang] / sum(before.values()), abs=0.02)


def test_languages_are_raked_to_their_targets(spark):
    d, t = docs(spark), spark.createDataFrame(TARGETS, "mix_id string, source string, target_share double, max_repeats long")
    goal = {"lang": {"en": 0.3, "de": 0.5, "": 0.2, "never": 0.4}}
    _, planned, how = fit(d.withColumn("doc", F.col("id")), t, goal)
    got = marginal_shares(mix(d, t, "id", marginals=goal, cells=True), planned).collect()
    assert {(r["label"], r["target_share"]) for r in got if r["dimension"] == "lang"} == {("en", 0.3), ("de", 0.5), ("", 0.2)}
    # What is drawn is near what was planned, and that near the target where the scarce source leaves room.
    assert all(abs(r["actual_share"] - r["planned_share"]) < 0.03 for r in got)
    assert all(abs(r["planned_share"] - r["target_share"]) < (1e-6 if r["dimension"] == "source" else 0.12) for r in got)
    assert set(how["mix_id"]) == {"a", "b"} and (how["last_change"] < 1e-6).all()
    with pytest.raises(ValueError):
        fit(d.withColumn("doc", F.col("id")), t, {"topic": {"never": 1.0}})


def test_empty_and_none(spark):
    t = spark.createDataFrame(TARGETS, "mix_id string, source string, target_share double, max_repeats long")
    assert rows(mix(docs(spark).limit(0), t, "id")) == [] and rows(mix(docs(spark, 50), t.limit(0), "id")) == []
    assert {r["actual_share"] for r in shares(mix(docs(spark).limit(0), t, "id"), t).collect()} == {None}


def test_fitting():
    assert water_fill(np.array([1.0, 1.0]), np.array([10.0, 30.0]), 2.0, 20.0).tolist() == [0.5, 0.5]
    assert water_fill(np.array([4.0, 1.0]), np.array([10.0, 10.0]), 1.0, 15.0).tolist() == [1.0, 0.5]
    assert water_fill(np.array([1.0]), np.array([10.0]), 2.0, 99.0).tolist() == [2.0]
    cells = {"s": np.array(["a", "a", "b", "b"]), "l": np.array(["x", "y", "x", "y"])}
    w, rounds, change = rake(cells, np.array([10.0, 20.0, 30.0, 40.0]), {"s": {"a": 30.0, "b": 20.0}, "l": {"x": 25.0, "y": 25.0}}, np.full(4, 5.0))
    assert rounds < 200 and change < 1e-9
    got = w * np.array([10.0, 20.0, 30.0, 40.0])
    assert got[:2].sum() == pytest.approx(30) and got[[0, 2]].sum() == pytest.approx(25, rel=1e-3)
