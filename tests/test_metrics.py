import pytest
from pyspark.sql import functions as F

from conftest import rows
from triplane.evaluation import metrics as m


def test_answers_compare_by_value(spark):
    df = spark.createDataFrame([(["1.0", "A "], ["a", "1"]), (["0"], []), (["2020-01-02T10:00:00"], ["2020-01-02"]), (["1.004"], ["1.0"]), (["x"], ["y", "x"]), (None, ["x"]), ([], None)], "got array<string>, gold array<string>")
    got = [tuple(r) for r in df.select(m.exact_match(F.col("got"), F.col("gold")), m.f1(F.col("got"), F.col("gold"))).collect()]
    assert [g[0] for g in got] == [True, True, True, True, False, False, True] and [round(g[1], 3) for g in got] == [1, 1, 1, 1, 0.667, 0, 1]


def test_reliability(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 0.99, False), ("a", 0.0, False), ("a", float("nan"), True), ("a", None, True), ("a", 0.2, None)], "g string, c double, ok boolean")
    bins = m.reliability(df, F.col("c"), F.col("ok"), ["g"])
    assert rows(bins, "bin", "n") == [(0, 1), (4, 2)]
    assert m.calibration_error(bins, ["g"]).first()["ece"] == pytest.approx((0 + 2 * 0.495) / 3)


def test_failures(spark):
    flags = ("correct", "unanswerable", "answered", "timeout", "error", "fallback", "gated")
    gold = ("entities", "module", "class", "shape", "properties")

    def why(**on):
        row = {**dict.fromkeys(flags, False), **dict.fromkeys(gold, None), **on}
        return spark.range(1).select(m.attribute_failure({k: F.lit(v).cast("boolean") for k, v in row.items()})).first()[0]

    assert why(correct=True) is None and why(unanswerable=True, answered=True) == "silent_answer" and why(timeout=True) == "execution_timeout"
    assert why(module=False, shape=False) == "routing_module" and why(entities=True, properties=False) == "property_choice"
    assert why(fallback=True) == "fallback_unanswered" and why(fallback=True, answered=True) == "fallback_wrong" and why(answered=True) == "generation" and why() == "other"
    assert {why(error=True), why(gated=True)} <= set(m.FAILURES)
