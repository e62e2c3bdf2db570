"""The N best items of every group, by one global range-partitioned sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..runtime import shuffle_partitions


def top_per_group(df: DataFrame, group: str, item: str, score: str, n: int, partitions: int | None = None) -> DataFrame:
    """``group, rank, item, score`` of the ``n`` best items of each group; rank from 1, dense in positions.

    An item counts once with its highest score. Higher scores come first, equal ones by ``item`` ascending (by
    Unicode code point). Rows with NULL group or item, or with NULL or NaN score, don't count; an infinite score
    does. Groups with fewer items give fewer rows, an empty table gives none. Other columns are ignored.

    Rows are first reduced to one per (group, item), map-side. Then all are range-partitioned and sorted by (group,
    score, item), so a group of any size is spread over as many tasks as its share of the rows asks for. Each task
    numbers its rows within the group and keeps the first ``n`` of each, with the group's count in the task; the
    counts of the tasks before are prefix-summed into exact positions. After the sort a group has at most ``n`` rows
    a task. No group is ever held by one task.
    """
    best = (
        df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"))
        .where("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
        .groupBy("g", "i")
        .agg(F.max("s").alias("s"))
    )
    order = [F.col("g").asc(), F.col("s").desc(), F.col("i").asc()]
    ordered = best.repartitionByRange(partitions or shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    local = StructType([*ordered.schema, StructField("task", IntegerType()), StructField("at", LongType()), StructField("count", LongType())])
    arrow = to_arrow_schema(local)

    def first_n(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        # A group's rows come in one run. Its count is known when the run ends, so its first n rows wait until then.
        held: list[pa.RecordBatch] = []
        count, last = 0, None

        def out(rows: list[pa.RecordBatch], counts: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).combine_chunks()
            columns = [*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns), pa.array(np.full(len(places), task, np.int32)), pa.array(places), pa.array(counts)]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                k = sum(b.num_rows for b in held)
                yield out(held, np.full(k, count, np.int64), np.arange(1, k + 1))
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0)
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(g.slice(1), g.slice(0, len(g) - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            if last is not None and g[0].as_py() == last:
                size = int(starts[1]) if len(starts) > 1 else batch.num_rows
                if count < n:
                    held.append(batch.slice(0, min(size, n - count)))
                count += size
                starts = starts[1:]
                if not len(starts):
                    continue
            yield from flush()
            ends = np.append(starts[1:], batch.num_rows)
            if len(starts) > 1:
                sizes = (ends - starts)[:-1]
                group_of = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(starts[0], ends[-2]) - starts[group_of] + 1
                keep = np.flatnonzero(place <= n)
                yield out([batch.take(pa.array(keep + starts[0]))], sizes[group_of[keep]].astype(np.int64), place[keep])
            size = int(ends[-1] - starts[-1])
            held.append(batch.slice(int(starts[-1]), min(size, n)))
            count, last = size, g[batch.num_rows - 1].as_py()
        yield from flush()

    kept = ordered.mapInArrow(first_n, local)
    before = Window.partitionBy("g").orderBy("task", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = F.sum(F.when(F.col("at") == 1, F.col("count")).otherwise(0)).over(before)
    place = counted - F.col("count") + F.col("at")
    return kept.withColumn("rank", place).where(F.col("rank") <= n).select(F.col("g").alias(group), "rank", F.col("i").alias(item), F.col("s").alias(score))
