"""Percentiles of large numeric columns from mergeable bucket counts with a relative error bound."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least positive double: every value but zero has a bucket of its own size.
SMALLEST = 5e-324
#: Least relative error. With it the numbers of buckets stay whole numbers that doubles hold exactly.
LEAST_ERROR = 1e-12


def _growth(error: float) -> tuple[float, int]:
    """The ratio of neighbouring bucket bounds, and what is added to a bucket's power to make it 1 or more."""
    if not LEAST_ERROR <= error < 1:
        raise ValueError(f"a relative error lies between {LEAST_ERROR} and 1, not {error}")
    g = (1 + error) / (1 - error)
    return g, 2 - math.floor(math.log(SMALLEST) / math.log(g))


def bucket_of(value: Column, error: float) -> Column:
    """The signed logarithmic bucket of a finite value.

    With g = (1 + error) / (1 - error), a positive value lies in bucket k when g^(k-1) < value <= g^k. The sign and k
    are packed into one integer: 0 for zero, k + an offset that makes it positive for the least double for positive
    values, the negative of that for negative ones, so that buckets sort as their values do.
    """
    g, offset = _growth(error)
    k = F.ceil(F.log(F.abs(value)) / math.log(g)).cast("long") + F.lit(offset).cast("long")
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, k).otherwise(-k)


def value_of(bucket: Column, error: float) -> Column:
    """The value that stands for a bucket: within ``error`` of each value in it, relatively."""
    g, offset = _growth(error)
    k = F.abs(bucket) - F.lit(offset)
    # The power of e is exact enough where a power of g, a number close to 1, is not.
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * F.exp(k * F.lit(math.log(g)) + F.lit(math.log(2 / (1 + g)))))


def sketch(df: DataFrame, by: list[str], value: str, error: float) -> DataFrame:
    """Bucket counts per group: ``by, bucket, n``. NULL, NaN and infinite values don't count; NULL groups are groups.

    The counts are partial sums in every task before one shuffle of at most (buckets of a group) rows each: for
    error 0.01 some 1,200 buckets span every value from 1e-5 to 1e5. A group of any share of the rows costs no more.
    """
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return df.where(finite).groupBy(*by, bucket_of(v, error).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of parts (days, partitions, runs of the job) as the sketch of the whole: matching counts are added.

    Exact: merging then reading equals counting everything at once, in any order and grouping.
    """
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, by: list[str], points: list[float], error: float) -> DataFrame:
    """Per group ``n`` and one column ``p<point>`` for each of ``points`` (in percent).

    The value at point q is that of the bucket with the value of rank ceil(q/100 * n) (at least 1) in it, the
    nearest-rank percentile; the result is within ``error`` of it, relatively, down to the least normal double (2.2e-308). Zeros are exact.
    """
    w = Window.partitionBy(*by)
    total = F.sum("n").over(w)
    upto = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    read = sketches.select(*by, "bucket", total.alias("total"), upto.alias("upto"))
    rank = lambda q: F.greatest(F.lit(1), F.ceil(F.col("total") * q / 100.0))
    columns = [F.min(F.when(F.col("upto") >= rank(q), F.col("bucket"))).alias(f"p{q:g}") for q in points]
    got = read.groupBy(*by).agg(F.max("total").alias("n"), *columns)
    return got.select(*by, "n", *[value_of(F.col(f"p{q:g}"), error).alias(f"p{q:g}") for q in points])
