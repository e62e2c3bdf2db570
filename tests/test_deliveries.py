import pytest
from pyspark.sql import functions as F

from conftest import rows
from triplane.operators.deliveries import _bytes, one_delivery


@pytest.mark.parametrize("largest", [None, 0])
def test_first_delivery_of_each_key(spark, largest):
    df = spark.createDataFrame(
        [(1, 5, "b", {"x": 1.0}), (1, 5, "a", {"x": 2.0}), (1, 9, "A", None), (2, None, "z", None), (2, 1, "a", None), (3, None, None, None), (None, 1, "q", None), (4, 2, "s", None), (4, 2, "s", None)],
        "id long, at long, t string, m map<string, double>",
    ).withColumn("r", F.lit("clash"))
    got = one_delivery(df, "id", ["at"], largest)
    assert got.columns == df.columns and rows(got.select("id", "at", "t")) == [(1, 5, "a"), (2, None, "z"), (3, None, None), (4, 2, "s")]
    assert rows(one_delivery(df, "id", [-F.col("at"), "t"], largest).select("id", "at")) == [(1, 9), (2, None), (3, None), (4, 2)]
    assert one_delivery(df.limit(0), "id", ["at"], largest).count() == 0


def test_sizes():
    assert [_bytes(x) for x in ("10485760b", "256k", "10MB", "-1", "1g", "77")] == [10485760, 262144, 10485760, -1, 1 << 30, 77]
