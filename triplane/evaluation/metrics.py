"""Metrics of runs, as Spark aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Where a wrong answer first went wrong.
FAILURES = ("silent_answer", "execution_timeout", "entity_linking", "routing_module", "routing_class", "query_shape", "property_choice", "fallback_unanswered", "gated_or_generation", "execution_error", "fallback_wrong", "generation", "other")


def answer_value(text: Column) -> Column:
    """A value in the form answers are compared in: numbers to two places, dates to the day, other text trimmed and lower."""
    number = F.round(text.try_cast("double"), 2)
    whole = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.substring(text, 1, 10))
    return F.coalesce(day, whole, F.lower(F.trim(text)))


def answer_set(values: Column) -> Column:
    """The distinct compared values of an answer; none and a lone 0 are the same."""
    s = F.array_sort(F.array_distinct(F.transform(F.coalesce(values, F.array().cast("array<string>")), answer_value)))
    return F.when((F.size(s) == 1) & (s[0] == "0"), F.array().cast("array<string>")).otherwise(s)


def exact_match(got: Column, gold: Column) -> Column:
    return answer_set(got) == answer_set(gold)


def f1(got: Column, gold: Column) -> Column:
    """The harmonic mean of precision and recall of two answers; 1 when both are empty, 0 when one is."""
    g, w = answer_set(got), answer_set(gold)
    both, sizes = F.size(F.array_intersect(g, w)), F.size(g) + F.size(w)
    return F.when(sizes == 0, 1.0).otherwise(2.0 * both / sizes)


def percentile(column: Column, q: float) -> Column:
    """With linear interpolation between ranks."""
    return F.percentile(column, q)


def reliability(df: DataFrame, confidence: Column, correct: Column, by: list[str], bins: int = 5) -> DataFrame:
    """Per group and bin of confidence: how many, their mean confidence and their accuracy. NULL and NaN are left out."""
    c = confidence.cast("double")
    rows = df.select(*by, c.alias("c"), correct.cast("double").alias("ok")).where("c IS NOT NULL AND NOT isnan(c) AND ok IS NOT NULL")
    bin_ = F.greatest(F.lit(0), F.least(F.floor(F.col("c") * bins), F.lit(bins - 1))).cast("int")
    return rows.groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("confidence"), F.avg("ok").alias("accuracy"))


def calibration_error(bins: DataFrame, by: list[str]) -> DataFrame:
    """Expected calibration error: the gaps between confidence and accuracy, weighted by the bins' sizes."""
    gap = F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))
    return bins.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def by_tag(df: DataFrame, tags: str, correct: Column) -> DataFrame:
    """Accuracy per tag; a run counts under each of its tags."""
    return df.select(F.explode(F.array_distinct(tags)).alias("tag"), correct.cast("double").alias("ok")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.avg("ok").alias("accuracy"))


def attribute_failure(r: dict[str, Column]) -> Column:
    """The first stage that disagrees with gold, of :data:`FAILURES`; NULL for correct runs.

    ``r`` has boolean columns ``correct, unanswerable, answered, timeout, error, fallback`` and, per stage, whether it
    agreed with gold, NULL where there is no gold: ``entities, module, class, shape, properties``; ``gated``.
    """
    no = lambda c: ~F.coalesce(c, F.lit(True))
    return (
        F.when(F.coalesce(r["correct"], F.lit(False)), None)
        .when(r["unanswerable"] & r["answered"], "silent_answer")
        .when(r["timeout"], "execution_timeout")
        .when(no(r["entities"]), "entity_linking")
        .when(no(r["module"]), "routing_module")
        .when(no(r["class"]), "routing_class")
        .when(no(r["shape"]), "query_shape")
        .when(no(r["properties"]), "property_choice")
        .when(r["fallback"] & ~r["answered"], "fallback_unanswered")
        .when(r["gated"], "gated_or_generation")
        .when(r["error"], "execution_error")
        .when(r["fallback"], "fallback_wrong")
        .when(r["answered"], "generation")
        .otherwise("other")
    )


def summarize(runs: DataFrame, by: list[str]) -> DataFrame:
    """Per arm: runs, accuracy, mean F1, rates of statuses, latency percentiles, mean time per stage.

    ``runs`` has ``correct`` boolean, ``f1`` double, ``status`` string, ``latency_ms`` double, ``stages`` map.
    """
    rate = lambda s: F.avg((F.col("status") == s).cast("double")).alias(s)
    fine = F.when(~F.isnan("latency_ms") & (F.col("latency_ms") >= 0), F.col("latency_ms"))
    main = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("f1").alias("f1"), *[rate(s) for s in ("answered", "no_data", "fallback", "unanswered", "error")], percentile(fine, 0.5).alias("p50"), percentile(fine, 0.95).alias("p95"))
    return main


def stage_means(runs: DataFrame, by: list[str]) -> DataFrame:
    """Mean seconds per stage."""
    return runs.select(*by, F.explode("stages").alias("stage", "ms")).where("ms IS NOT NULL AND NOT isnan(ms)").groupBy(*by, "stage").agg((F.avg("ms") / 1000).alias("seconds"), F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Each row's part of its group's total."""
    return df.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(*by)))
