"""Statements that keep arriving: N-Triples files read as a stream into a store that stays a set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.quads import distinct_quads, parse_lines, store_is_empty, typed


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as lines."""
    return spark.readStream.format("text").load(folder)


def stream_into(spark: SparkSession, folder: str, graph: str, store: str, checkpoint: str) -> StreamingQuery:
    """Files of N-Triples that appear in ``folder`` are added to ``store`` once each, statements known already are not.

    Runs until the files there are done. Each batch is anti-joined with the graph it goes to; a batch that is run
    again after a failure finds its own statements there and adds nothing.
    """
    def add(batch: DataFrame, _: int) -> None:
        fresh = typed(distinct_quads(parse_lines(batch, graph)))
        if not store_is_empty(spark, store):
            old = spark.read.parquet(store).where(F.col("g") == graph).select("g", "s", "p", "o", "o_kind", "o_dt", "o_lang")
            on = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in old.columns]
            fresh = fresh.alias("n").join(old.alias("k"), on, "left_anti")
        fresh.write.mode("append").partitionBy("g", "p").parquet(store)

    return stream_lines(spark, folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
