"""Items packed into containers of fixed capacity by exact complements of their lengths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..runtime import materialize

#: Greatest capacity. The plan is made on the driver from one count per length, so this bounds what it holds,
#: whatever the number of items.
MAX_CAPACITY = 1 << 20
#: Candidates for three lengths that may fail before the sums of pairs are indexed anew.
STALE = 64


class Stock:
    """How many items there are of each length up to the capacity, with indexes of lengths and of sums of two.

    An index is a set of whole numbers as the bits of one number, once upwards and once downwards from the capacity:
    shifting the second by capacity - gap puts gap - a where a stands in the first, so one AND finds all lengths whose
    complement is there too.
    """

    def __init__(self, capacity: int, counts: dict[int, int]) -> None:
        self.capacity = capacity
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            self.left[length] += n
        self.up = sum_bits(length for length, n in enumerate(self.left) if n and length)
        self.down = sum_bits(capacity - length for length, n in enumerate(self.left) if n and length)
        self.pairs_down = None
        self.top = capacity

    def take(self, length: int, n: int = 1) -> None:
        self.left[length] -= n
        if not self.left[length]:
            self.up ^= 1 << length
            self.down ^= 1 << (self.capacity - length)

    def largest(self, upto: int) -> int:
        """The greatest length in stock that is at most ``upto``; 0 if there is none."""
        if upto >= self.top:
            while self.top and not self.left[self.top]:
                self.top -= 1
            return self.top
        return max(0, (self.up & ((2 << upto) - 1)).bit_length() - 1)

    def pair(self, total: int, used: int = 0) -> int:
        """The least of two lengths in stock with the sum ``total``, if one of ``used`` is taken already; 0 if none."""
        found = self.up & (self.down >> (self.capacity - total)) & ((2 << (total // 2)) - 1)
        while found:
            a = (found & -found).bit_length() - 1
            b = total - a
            if self.left[a] > (a == b) + (a == used) and self.left[b] > (a == b) + (b == used):
                return a
            found ^= 1 << a
        return 0

    def index_pairs(self) -> None:
        """The sums of two lengths in stock, up to the capacity. Later sums may be gone, but none is new."""
        sums = 0
        full = (2 << self.capacity) - 1
        for a in range(1, self.capacity // 2 + 1):
            if self.left[a]:
                sums |= ((self.up >> a) << (2 * a)) & full if self.left[a] > 1 else (((self.up >> (a + 1)) << (a + 1)) << a) & full
        self.pairs_down = int(bin(sums | 1 << (self.capacity + 1))[:2:-1], 2) if sums else 0

    def complement(self, gap: int) -> list[int]:
        """One, two or three lengths in stock with the sum ``gap``, larger ones first; none if there are none."""
        if gap <= 0:
            return []
        if self.left[gap]:
            return [gap]
        if a := self.pair(gap):
            return [gap - a, a]
        for _ in range(2):
            if self.pairs_down is None:
                self.index_pairs()
            # Of three lengths the greatest is a third of the gap or more.
            found = self.up & (self.pairs_down >> (self.capacity - gap)) & ((1 << gap) - 1)
            failed = 0
            while found and failed < STALE:
                a = found.bit_length() - 1
                if 3 * a < gap:
                    return []
                if b := self.pair(gap - a, a):
                    return sorted([a, b, gap - a - b], reverse=True)
                found ^= 1 << a
                failed += 1
            if not found:
                return []
            self.pairs_down = None
        # The index is new, and sums stand in it that need more items of a length than there are: look at all.
        while found and 3 * (a := found.bit_length() - 1) >= gap:
            if b := self.pair(gap - a, a):
                return sorted([a, b, gap - a - b], reverse=True)
            found ^= 1 << a
        return []


def sum_bits(places) -> int:  # noqa: ANN001
    """The number with a bit at each of ``places``."""
    places = list(places)
    if not places:
        return 0
    bits = np.zeros(max(places) + 1, np.uint8)
    bits[places] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def plan(capacity: int, counts: dict[int, int]) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns ``(containers, [(length, items of it in each)])`` that use every item once.

    Each container opens with the longest item left. If one, two or three lengths in stock fill its gap exactly, they
    close it; else the best-fitting (longest) item goes in and the gap is tried again, until nothing fits. A pattern
    is repeated as long as the stock allows, so there are at most some two patterns a length however many items there
    are.
    """
    stock, patterns = Stock(capacity, counts), []
    while top := stock.largest(capacity):
        chosen = Counter([top])
        stock.take(top)
        gap = capacity - top
        while gap:
            most = stock.largest(gap)
            if not most:
                break
            exact = stock.complement(gap) if gap <= 3 * most else []
            for length in exact or [most]:
                chosen[length] += 1
                stock.take(length)
                gap -= length
        more = min(stock.left[length] // n for length, n in chosen.items())
        if more:
            for length, n in chosen.items():
                stock.take(length, n * more)
        patterns.append((1 + more, sorted(chosen.items(), reverse=True)))
    return patterns


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the items of each length go: (length << 40 | first rank), container of that rank, sorted; and lengths' ends.

    Items of a length are ranked from 0; a slot takes a run of ranks, one container further each.
    """
    used: Counter[int] = Counter()
    key, to, container = [], [], 0
    for times, parts in patterns:
        for length, n in parts:
            for _ in range(n):
                key.append((length << 40) | used[length])
                to.append(container)
                used[length] += times
        container += times
    order = np.argsort(np.array(key, np.int64), kind="stable")
    return np.array(key, np.int64)[order], np.array(to, np.int64)[order], np.array([container])


def pack(items: DataFrame, item: str, tokens: str, capacities: dict[int, int]) -> DataFrame:
    """``spec, container, item, piece, token_start, token_end``: every item's place for each of ``capacities``.

    ``capacities`` maps a spec to its capacity. An item is cut only when longer than the capacity: each full piece is
    a container of its own, the rest is packed like an item. Pieces count from 0; token offsets are exclusive at the
    end. Containers count from 0 in each spec. Items with no tokens (or NULL) need no place: they get one row with
    NULL container. Negative lengths count as none. Rows that repeat an item are packed each. An empty table gives no
    rows.

    Lengths are counted in one aggregation; the counts (at most one per length up to :data:`MAX_CAPACITY`) are all the
    driver sees. It plans patterns of lengths; tasks number their items per length, and prefix sums of the tasks'
    counts make these numbers ranks, so no length, however common, is sorted or held by one task. A rank's container
    is then looked up in the plan, whose size depends on the capacity only.
    """
    spark = items.sparkSession
    for spec, capacity in capacities.items():
        if not 0 < capacity <= MAX_CAPACITY:
            raise ValueError(f"capacity {capacity} of spec {spec} is not within 1 and {MAX_CAPACITY}")
    specs = F.array(*[F.struct(F.lit(s).cast("long").alias("spec"), F.lit(c).cast("long").alias("capacity")) for s, c in capacities.items()])
    if not capacities:
        return spark.createDataFrame([], f"spec long, container long, {item} {dict(items.dtypes)[item]}, piece long, token_start long, token_end long")
    base = items.select(F.col(item).alias("item"), F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("long").alias("tokens"))
    each = base.select("item", "tokens", F.explode(specs).alias("s")).select("s.spec", "s.capacity", "item", "tokens")
    each = each.withColumn("rest", F.col("tokens") % F.col("capacity")).withColumn("rest", F.when((F.col("rest") == 0) & (F.col("tokens") > 0), F.col("capacity")).otherwise(F.col("rest")))
    schema = StructType([*each.schema, StructField("task", IntegerType()), StructField("local", LongType())])
    arrow = to_arrow_schema(schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            keys = (batch.column(0).to_numpy() << 21) | batch.column(4).to_numpy()
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, int)
            sizes = np.diff(np.append(first, len(keys)))
            before = np.array([seen.get(k, 0) for k in ordered[first].tolist()], np.int64)
            for k, b, n in zip(ordered[first].tolist(), before.tolist(), sizes.tolist(), strict=True):
                seen[k] = b + n
            local = np.empty(len(keys), np.int64)
            local[order] = np.arange(len(keys)) - np.repeat(first - before, sizes)
            columns = [*batch.columns, pa.array(np.full(len(keys), task, np.int32)), pa.array(local)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    numbered = materialize(each.mapInArrow(number, schema), "items")
    counts = materialize(numbered.groupBy("spec", "rest", "task").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("tokens") - F.col("rest")) / F.col("capacity")).cast("long").alias("full")), "counts")
    by_task = Window.partitionBy("spec", "rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("spec", "rest", "task", F.coalesce(F.sum("n").over(by_task), F.lit(0)).alias("offset"))
    # one row per spec and length: at most the sum of the capacities
    histogram = counts.groupBy("spec", "rest").agg(F.sum("n").alias("n")).where("rest > 0").collect()
    tables, ends = {}, {}
    for spec, capacity in capacities.items():
        tables[spec] = slots(plan(capacity, {r["rest"]: r["n"] for r in histogram if r["spec"] == spec}))
        ends[spec] = int(tables[spec][2][0])
    plans = spark.sparkContext.broadcast({s: t[:2] for s, t in tables.items()})
    ranked = numbered.join(offsets, ["spec", "rest", "task"]).withColumn("rank", F.col("local") + F.col("offset"))

    @F.pandas_udf("long")
    def container_of(spec, rest, rank):  # noqa: ANN001, ANN202
        import pandas as pd

        got = pd.array(np.zeros(len(spec), np.int64), dtype="Int64")
        s, key = spec.to_numpy(), (rest.to_numpy() << 40) | rank.to_numpy()
        for one in np.unique(s):
            starts, to = plans.value[int(one)]
            mine = (s == one) & (rest.to_numpy() > 0)
            at = np.searchsorted(starts, key[mine], side="right") - 1
            got[mine] = to[at] + key[mine] - starts[at] if mine.any() else 0
        got[rest.to_numpy() == 0] = pd.NA
        return pd.Series(got)

    placed = ranked.select("spec", "capacity", "item", "tokens", "rest", container_of("spec", "rest", "rank").alias("container"))
    last = placed.select("spec", "container", "item", F.floor((F.col("tokens") - F.col("rest")) / F.col("capacity")).alias("piece"), (F.col("tokens") - F.col("rest")).alias("token_start"), F.col("tokens").alias("token_end"))
    # Full pieces take containers after the planned ones; items that have any are numbered by the same prefix sums.
    long_task = Window.partitionBy("spec").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    cut = placed_full(numbered, counts, long_task, ends)
    return last.unionByName(cut).withColumnRenamed("item", item)


def placed_full(numbered: DataFrame, counts: DataFrame, by_task, ends: dict[int, int]) -> DataFrame:  # noqa: ANN001
    """The full pieces of items longer than the capacity, one container each, after those of the plan."""
    per_task = counts.groupBy("spec", "task").agg(F.sum("full").alias("full"))
    offset = per_task.where("full > 0").select("spec", "task", F.coalesce(F.sum("full").over(by_task), F.lit(0)).alias("offset"))
    pieces = numbered.where("tokens > capacity").withColumn("full", ((F.col("tokens") - F.col("rest")) / F.col("capacity")).cast("long")).join(offset, ["spec", "task"])
    # Within a task by length and local number: both together are unique there.
    within = Window.partitionBy("spec", "task").orderBy("rest", "local").rowsBetween(Window.unboundedPreceding, -1)
    base = F.element_at(F.create_map(*[x for s, e in ends.items() for x in (F.lit(s).cast("long"), F.lit(e).cast("long"))]), F.col("spec"))
    at = base + F.col("offset") + F.coalesce(F.sum("full").over(within), F.lit(0))
    each = pieces.withColumn("at", at).select("spec", "capacity", "item", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
    return each.select("spec", (F.col("at") + F.col("piece")).alias("container"), "item", "piece", (F.col("piece") * F.col("capacity")).alias("token_start"), ((F.col("piece") + 1) * F.col("capacity")).alias("token_end"))


def fill(placed: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """Per spec the containers, the tokens in them, the least number that could hold them, and the share filled."""
    size = F.element_at(F.create_map(*[x for s, c in capacities.items() for x in (F.lit(s).cast("long"), F.lit(c).cast("long"))]), F.col("spec"))
    t = placed.where("container IS NOT NULL").groupBy("spec", "container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"))
    got = t.groupBy("spec").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return got.withColumn("capacity", size).withColumn("least", F.ceil(F.col("tokens") / F.col("capacity"))).withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
