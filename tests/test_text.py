import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from triplane.functions import text as t
from triplane.functions.literals import extract_literals, literals_udf


def test_forms_of_a_word_meet():
    assert t.stem("hired") == t.stem("hire") and t.stem("prices") == t.stem("price") and t.stem("cheapest") == t.stem("cheap")
    assert t.stem("cities") == "city" and t.stem("glass") == "glass" and t.stem("2020") == "2020"


def test_normal_form():
    assert t.normalize("Ford's  Crème-Brûlée, №5!") == "ford creme brulee no5"
    assert t.tokens("soldModelCode_of the car") == ["sold", "model", "code", "car"]
    assert t.trigrams("ab") == {"  a", " ab", "ab "} and t.trigram_similarity("abc", "abd") == 2 / 6
    assert t.flatten_json({"a": [1, {"b": None}]}) == "a 1 b " and t.approx_tokens("") == 1
    assert sum(t.softmax([1, 2, 3], 0.6)) == pytest.approx(1) and t.softmax([]) == []


def test_columns_do_as_functions(spark):
    texts = ["", "The Ford's prices", "cheapest hiredCars_now", "Žluťoučký kůň", "Æsir ß", "running glasses 2020s", "  ", "Ünï’s"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    got = df.select("x", t.normalize_col(F.col("x")).alias("n"), t.normalize_udf("x").alias("u"), t.stems_col(F.col("x")).alias("s"), t.trigrams_col(F.col("x")).alias("g")).collect()
    for r in got:
        assert r["n"] == r["u"] == t.normalize(r["x"]) and r["s"] == t.stems(r["x"]) and set(r["g"]) == t.trigrams(r["x"])
    assert df.select(t.normalize_col(F.lit(None).cast("string")).alias("n")).first()["n"] is None


def test_softmax_and_bigrams(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "g int, s double")
    got = rows(df.select("g", F.round(t.softmax_col(F.col("s"), Window.partitionBy("g")), 4).alias("p")))
    assert got == [(1, 0.2689), (1, 0.7311), (2, 1.0)]
    assert [tuple(p) for p in df.select(t.bigrams_col(F.array(*[F.lit(x) for x in "abc"])).alias("b")).first()["b"]] == [("a", "b"), ("b", "c")]


@settings(max_examples=60, deadline=None)
@given(some.text(alphabet=some.characters(codec="latin-1"), max_size=40))
def test_stems_are_stable(x):
    assert t.normalize(t.normalize(x)) == t.normalize(x)


def test_literals():
    kinds = {x: [(f.kind, f.value, f.low, f.high) for f in extract_literals(x)] for x in ("in Q3 2025", "the first quarter of 2024", "on 2024-02-29", "Feb. 2023", "in 2024", "$50,000", "45k cars", "1.5 million", "2024-13-45")}
    assert kinds["in Q3 2025"] == [("date_range", None, dt.date(2025, 7, 1), dt.date(2025, 9, 30))]
    assert kinds["the first quarter of 2024"][0][2:] == (dt.date(2024, 1, 1), dt.date(2024, 3, 31))
    assert kinds["on 2024-02-29"][0][:2] == ("date", dt.date(2024, 2, 29)) and kinds["Feb. 2023"][0][3] == dt.date(2023, 2, 28)
    assert kinds["in 2024"] == [("year", 2024, dt.date(2024, 1, 1), dt.date(2024, 12, 31))]
    assert [kinds[x][0][:2] for x in ("$50,000", "45k cars", "1.5 million")] == [("number", 50000), ("number", 45000), ("number", 1500000)]
    assert extract_literals("Model 3 in 2024", [(0, 7)])[0].text == "2024"


def test_literals_in_a_column(spark):
    df = spark.createDataFrame([("Q1 2020 and 7",), (None,), ("",)], "x string")
    got = df.select(literals_udf("x").alias("l")).collect()
    assert [x and len(x["l"]) if x["l"] is not None else None for x in got] == [2, None, 0]
