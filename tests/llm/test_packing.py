import bisect
import random
import time

import pytest
from pyspark.sql import functions as F

from conftest import rows
from triplane.llm import packing
from triplane.llm.packing import MAX_CAPACITY, Stock, fill, pack, plan
from triplane.llm.tokens import VOCABULARY, encoding, with_tokens


def best_fit_decreasing(lengths, capacity):
    room, containers = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(room, n)
        if at < len(room):
            bisect.insort(room, room.pop(at) - n)
        else:
            containers += 1
            bisect.insort(room, capacity - n)
    return containers


@pytest.mark.parametrize(("capacity", "lengths"), [(10, [10, 7, 3, 4, 4, 2, 1, 1]), (7, [5] * 40), (64, random.Random(1).choices(range(1, 65), k=3000)), (5, [])])
def test_plan_uses_each_item_once_and_fits(capacity, lengths):
    counts = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    used = {}
    containers = 0
    for times, parts in plan(capacity, counts):
        assert sum(length * n for length, n in parts) <= capacity
        containers += times
        for length, n in parts:
            used[length] = used.get(length, 0) + n * times
    assert used == counts
    assert containers <= best_fit_decreasing(lengths, capacity)
    if capacity == 7:
        assert containers == 40


def brute_complement(left, gap):
    lengths = [n for n in left if left[n]]
    enough = lambda *parts: sum(parts) == gap and all(left[p] >= parts.count(p) for p in parts)
    return any(enough(a) for a in lengths) or any(enough(a, b) for a in lengths for b in lengths) or any(enough(a, b, c) for a in lengths for b in lengths for c in lengths)


@pytest.mark.parametrize("stale", [1, 64])
def test_complements_by_brute_force(monkeypatch, stale):
    monkeypatch.setattr(packing, "STALE", stale)
    rng = random.Random(stale)
    for _ in range(60):
        capacity = rng.randint(3, 60)
        s = Stock(capacity, {rng.randint(1, capacity): rng.randint(1, 3) for _ in range(rng.randint(1, 9))})
        while s.largest(capacity):
            left = {n: k for n, k in enumerate(s.left) if k}
            for gap in range(capacity + 1):
                got = s.complement(gap)
                assert (bool(got) == (gap > 0 and brute_complement(left, gap))) and sum(got) == (gap if got else 0) and all(got.count(n) <= left[n] for n in got), (left, gap, got)
                assert s.largest(gap) == max([n for n in left if n <= gap], default=0)
            s.take(rng.choice(list(left)))


def test_large_capacity_in_seconds():
    capacity = 1 << 17
    began = time.time()
    assert sum(n for n, _ in plan(capacity, {n: 1 + n % 5 for n in range(1, capacity + 1)})) > 0
    assert time.time() - began < 10


def test_complements():
    s = Stock(30, {3: 2, 7: 1, 11: 1})
    assert s.complement(7) == [7] and s.complement(10) == [7, 3] and s.complement(6) == [3, 3] and s.complement(21) == [11, 7, 3] and s.complement(9) == [] and s.complement(17) == [11, 3, 3]


@pytest.mark.parametrize("parts", [1, 6])
def test_every_token_has_one_place(spark, parts):
    rng = random.Random(parts)
    sizes = [rng.choice([0, 0, 16, 16, 16, rng.randint(1, 20), rng.randint(1, 200)]) for _ in range(900)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(5000, None), (5001, -3)], "id long, tokens long").withColumn("container", F.lit("clash")).repartition(parts)
    caps = {1: 16, 2: 50}
    got = pack(df, "id", "tokens", caps).collect()
    for spec, cap in caps.items():
        mine = [r for r in got if r["spec"] == spec]
        covered, load = {}, {}
        for r in mine:
            covered.setdefault(r["id"], []).append((r["token_start"], r["token_end"]))
            assert (r["container"] is None) == (r["token_end"] == r["token_start"])
            if r["container"] is not None:
                load[r["container"]] = load.get(r["container"], 0) + r["token_end"] - r["token_start"]
        for i, n in enumerate(sizes):
            spans = sorted(covered[i])
            assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and (len(spans) == 1 or n > cap)
        assert max(load.values()) <= cap and sorted(load) == list(range(len(load))) and {5000, 5001} <= covered.keys()
        assert len(load) <= -(-sum(sizes) // cap) * 1.02 + 1
    report = {r["spec"]: r for r in fill(pack(df, "id", "tokens", caps), caps).collect()}
    assert report[1]["fullest"] <= 16 and report[1]["containers"] >= report[1]["least"]


def test_empty_and_wrong(spark):
    df = spark.createDataFrame([], "id long, tokens long")
    assert rows(pack(df, "id", "tokens", {1: 8})) == [] and rows(pack(df, "id", "tokens", {})) == []
    with pytest.raises(ValueError, match="capacity"):
        pack(df, "id", "tokens", {1: MAX_CAPACITY + 1})


def test_a_length_of_a_third_of_all_items(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 100).otherwise(F.col("id") % 50 + 1).cast("long").alias("tokens"))
    got = fill(pack(df, "id", "tokens", {1: 256}), {1: 256}).first()
    assert got["containers"] <= got["least"] * 1.001 + 1


def test_tokens(spark):
    e = encoding(VOCABULARY)
    texts = ["Hello world", "", None, "ä" * 3000, "<|endoftext|>", " " * 5000, "word " * 20_000]
    got = dict(rows(with_tokens(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text")))
    assert got == {i: len(e.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert e.decode(e.encode_ordinary(texts[0])) == texts[0]
