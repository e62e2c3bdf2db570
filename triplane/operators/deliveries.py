"""One row for each key of a table whose rows may be delivered more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that a key held in memory by every task may take, with its place in a hash table.
KEY_BYTES = 64


def one_delivery(df: DataFrame, key: str, order: list[str | Column], largest: int | None = None) -> DataFrame:
    """The row of each ``key`` that comes first by ``order``, with all columns of ``df``.

    Equal rows are one; rows that agree in ``order`` and differ elsewhere are told apart by their other columns that
    can be compared. NULLs come first, so a key all of whose orders are NULL keeps a row. Rows with NULL key are left out.

    Few keys come more than once as a rule. Those are counted first, by a shuffle of the keys alone; if they fit into
    ``largest`` bytes (by default what Spark itself would broadcast), they are sent to every task, and only *their* rows
    are shuffled. Otherwise all rows are grouped by key. Both ways have the same result.
    """
    rows = df.where(F.col(key).isNotNull())
    rest = [F.col(c) for c in df.columns if c != key]
    sortable = [c for c, t in df.dtypes if "map" not in t and c != key]

    def first(part: DataFrame) -> DataFrame:
        by = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(sortable)])
        return part.groupBy(key).agg(F.min_by(F.struct(*rest), by).alias("r")).select(key, "r.*").select(*df.columns)

    again = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    if largest is None:
        largest = _bytes(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    if again.count() * KEY_BYTES > largest:
        return first(rows)
    small = F.broadcast(again)
    return rows.join(small, key, "left_anti").select(*df.columns).unionByName(first(rows.join(small, key, "left_semi").select(*df.columns)))


def _bytes(size: str) -> int:
    """A size as Spark writes it: digits, then k, m or g, then b or nothing."""
    text = size.lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(text[-1], 0)
    return int(text.rstrip("kmg")) << unit if not text.startswith("-") else -1
