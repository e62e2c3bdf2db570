"""Records that differ in form only, found by one external sort of their canonical form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from ..runtime import materialize, shuffle_partitions


def equal_runs(df: DataFrame, key: str, rec: str, partitions: int | None = None) -> DataFrame:
    """``rec, keep``: for each record the least ``rec`` of the records with the same ``key``.

    ``rec`` identifies a record; rows that repeat a ``rec`` count once. NULL keys or recs give no rows; the empty key
    is a key like any other. Ties don't arise, as order is by (key, rec). An empty table gives no rows.

    Records are range-partitioned and sorted by (key, rec), so a key with a third of all rows is cut over tasks like
    any other range. Each task scans its rows, compares full keys with the row before, and names each run by its
    first record, the least. Only a task's first run may have begun earlier: each task leaves its first and last key
    on two border rows, and a scan of those, two rows a task, tells where such a run began.
    """
    spark = df.sparkSession
    # Written first: the range partitioning samples its input before it reads it, and keys are costly to make.
    rows = materialize(df.select(F.col(key).alias("k"), F.col(rec).alias("r")).where("k IS NOT NULL AND r IS NOT NULL"), "keys")
    ordered = rows.repartitionByRange(partitions or shuffle_partitions(spark), "k", "r").sortWithinPartitions("k", "r")
    kinds = {f.name: f.dataType for f in ordered.schema}
    schema = StructType([StructField("r", kinds["r"]), StructField("keep", kinds["r"]), StructField("task", IntegerType()), StructField("run0", BooleanType()), StructField("edge", IntegerType()), StructField("k", kinds["k"])])
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, run = TaskContext.get().partitionId(), -1
        first = last_k = last_r = last_keep = None

        def edge(number: int, k: object, keep: object) -> pa.RecordBatch:
            row = [None, keep, task, None, number, k]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            k, r = batch.column(0), batch.column(1)
            new, fresh = np.ones(m, bool), np.ones(m, bool)
            if m > 1:
                new[1:] = pc.not_equal(k.slice(1), k.slice(0, m - 1)).to_numpy(zero_copy_only=False)
                fresh[1:] = new[1:] | pc.not_equal(r.slice(1), r.slice(0, m - 1)).to_numpy(zero_copy_only=False)
            new[0] = run < 0 or k[0].as_py() != last_k
            fresh[0] = new[0] or r[0].as_py() != last_r
            start = np.maximum.accumulate(np.where(new, np.arange(m), -1))
            keep = r.take(pa.array(np.maximum(start, 0)))
            if not new[0]:
                keep = pc.if_else(pa.array(start < 0), pa.scalar(last_keep, r.type), keep)
            runs = run + np.cumsum(new)
            got = pa.RecordBatch.from_arrays([r, keep, pa.array(np.full(m, task, np.int32)), pa.array(runs == 0), pa.nulls(m, pa.int32()), pa.nulls(m, arrow.field(5).type)], schema=arrow)
            yield got.filter(pa.array(fresh))
            if run < 0:
                first = (k[0].as_py(), r[0].as_py())
            run, last_k, last_r, last_keep = int(runs[-1]), k[m - 1].as_py(), r[m - 1].as_py(), keep[m - 1].as_py()
        if run >= 0:
            yield edge(0, *first)
            if run > 0:
                yield edge(1, last_k, last_keep)

    scanned = materialize(ordered.mapInArrow(scan, schema), "runs")
    seq = Window.orderBy("task", "edge")
    edges = scanned.where("edge IS NOT NULL").select("task", "edge", "k", "keep")
    chain = edges.withColumn("chain", F.sum(F.when(F.lag("k").over(seq) == F.col("k"), 0).otherwise(1)).over(seq))
    begun = chain.select("task", "edge", F.min("keep").over(Window.partitionBy("chain")).alias("begun")).where("edge = 0").drop("edge")
    named = scanned.where("edge IS NULL").join(F.broadcast(begun), "task").select("r", F.when(F.col("run0"), F.col("begun")).otherwise(F.col("keep")).alias("keep"))
    return named.select(F.col("r").alias(rec), "keep")


def copy_counts(runs: DataFrame) -> DataFrame:
    """``keep, copies``: one row per record kept, with how many records it stands for, itself included."""
    return runs.groupBy("keep").agg(F.count(F.lit(1)).alias("copies"))
