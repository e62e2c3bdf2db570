"""Freely entered values mapped to the closest entry of a reference list."""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..runtime import materialize, shuffle_partitions

#: Least Jaccard similarity of the token sets of a value and an entry. One edit in a word of six letters keeps 0.4.
NEAR = 0.4
#: Shared rare tokens a candidate must have: two sets as similar as NEAR share this many among their rare prefixes, if
#: those are as many tokens longer.
SHARED = 3
#: The join runs in cells of one block of values and one shard of names. Both bound a cell's memory.
VALUES_A_BLOCK = 50_000
NAMES_A_SHARD = 20_000
#: Entries of posting lists, and tokens of pairs to be compared, that are in memory at once in a cell.
POSTINGS_AT_ONCE = 4_000_000
_EPS = 1e-9


def name_form(text: str | None) -> str | None:
    """Lower-case words without accents, apostrophes and other signs, one space between words; of any script."""
    if text is None:
        return None
    if text.isascii():
        plain = text.lower().replace("'", "").replace("`", "")
    else:
        plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
        plain = re.sub(r"['’`´]", "", plain)
    return " ".join(re.findall(r"[^\W_]+", plain))


def tokens_of(form: str) -> set[str]:
    """The pairs of neighbouring characters, word ends included as spaces; the order of words leaves little trace."""
    padded = f" {form} "
    return {padded[i : i + 2] for i in range(len(padded) - 1)}


@F.pandas_udf(StringType())
def form_udf(text: pd.Series) -> pd.Series:
    return text.map(name_form, na_action="ignore")


def reference_names(entries: DataFrame, key: str, names: list[Column], weight: str) -> DataFrame:
    """``form, key``: each name's entry. A name of several entries goes to the one of greatest weight, then least key.

    Rows may repeat an entry. NULL names, NULL keys and names without letters or digits are left out; a NULL weight
    is the least.
    """
    flat = entries.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(weight).alias("weight"), F.explode(F.array_distinct(F.concat(*[F.coalesce(n, F.array().cast("array<string>")) for n in names]))).alias("name"))
    formed = flat.where("name IS NOT NULL").select("key", F.coalesce(F.col("weight").cast("double"), F.lit(float("-inf"))).alias("weight"), form_udf("name").alias("form")).where("form <> ''")
    return formed.groupBy("form").agg(F.min(F.struct((-F.col("weight")).alias("w"), "key")).alias("b")).select("form", "b.key")


# ---------------------------------------------------------------- the join of one cell
def token_sets(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and token codes of the sets of all forms, ordered by row; a code is two code points."""
    chars = np.frombuffer("".join(f"\n {f} " for f in forms).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.cumsum(chars == 10) - 1
    inside = (chars[:-1] != 10) & (chars[1:] != 10)
    code = chars[:-1].astype(np.uint64)[inside] << np.uint64(32) | chars[1:].astype(np.uint64)[inside]
    order = np.lexsort((code, row[:-1][inside]))
    row, code = row[:-1][inside][order], code[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[new], code[new]


class Sets:
    """The token sets of a side of a cell, each in the order of rarity."""

    def __init__(self, row: np.ndarray, rank: np.ndarray, rows: int) -> None:
        order = np.lexsort((rank, row))
        self.row, self.rank = row[order], rank[order]
        self.size = np.bincount(row, minlength=rows)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.at = np.arange(len(row)) - self.start[self.row]


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``count`` from ``start``: the number of the range, and the place, of every element."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count - start, count)


def _parts(weights: np.ndarray, limit: int) -> np.ndarray:
    """Bounds of runs of neighbours whose weights add up to some ``limit``."""
    return np.flatnonzero(np.diff(np.cumsum(weights) // limit, prepend=-1, append=np.iinfo(np.int64).max))


def near_pairs(values: list[str], names: list[str], rarity: dict[int, int], near: float = NEAR, shared: int = SHARED) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """All pairs of a value and a name with Jaccard ``near`` or more: their numbers and similarity; and how many were compared.

    ``rarity`` has the count of each token code in all names. Tokens are ordered by it. A pair of sizes n and m as
    similar as that has o = ceil(near / (1 + near) * (n + m)) tokens in common or more, so at least s = min(shared, o)
    of them stand among the first n - o + s of one *and* the first m - o + s of the other: only names that meet a value
    so often in these prefixes are compared with it. Each posting holds the token's place, so that the prefixes are as
    short as the two sizes allow.
    """
    vr, vc = token_sets(values)
    nr, nc = token_sets(names)
    codes = np.unique(nc)
    count = np.array([rarity.get(int(c), 0) for c in codes])
    rank_of = np.empty(len(codes), np.int64)
    rank_of[np.lexsort((codes, count))] = np.arange(len(codes))
    at = np.searchsorted(codes, vc)
    known = (at < len(codes)) & (codes[np.minimum(at, len(codes) - 1)] == vc) if len(codes) else np.zeros(len(vc), bool)
    # Tokens in no name are the rarest of all: they come first in a value and meet nothing.
    rank = np.where(known, rank_of[np.minimum(at, max(len(codes) - 1, 0))], -1 - np.arange(len(vc))) if len(codes) else -1 - np.arange(len(vc))
    v, n = Sets(vr, rank, len(values)), Sets(nr, rank_of[np.searchsorted(codes, nc)], len(names))
    longest = lambda s: s.size - np.ceil(s.size * near - _EPS).astype(np.int64) + shared
    # Postings: the names of a token, by their size.
    mine = n.at < longest(n)[n.row]
    order = np.lexsort((n.size[n.row[mine]], n.rank[mine]))
    post_name, post_at, post_rank = n.row[mine][order], n.at[mine][order], n.rank[mine][order]
    span = int(n.size.max(initial=0)) + 1
    post_key = post_rank * span + n.size[post_name]
    probe = np.flatnonzero((v.at < longest(v)[v.row]) & (v.rank >= 0))
    size = v.size[v.row[probe]]
    low = np.searchsorted(post_key, v.rank[probe] * span + np.ceil(size * near - _EPS).astype(np.int64))
    high = np.searchsorted(post_key, v.rank[probe] * span + np.minimum(np.floor(size / near + _EPS).astype(np.int64), span - 1), "right")
    hits = np.maximum(high - low, 0)
    per_value = np.bincount(v.row[probe], weights=hits, minlength=len(values)).astype(np.int64)
    out, compared = [], 0
    bounds = _parts(per_value, POSTINGS_AT_ONCE)
    for a, b in zip(bounds, bounds[1:], strict=False):
        some = slice(*np.searchsorted(v.row[probe], (a, b)))
        of, place = _spread(low[some], hits[some])
        of = of + some.start
        x, y = v.row[probe[of]], post_name[place]
        o = np.ceil((v.size[x] + n.size[y]) * (near / (1 + near)) - _EPS).astype(np.int64)
        s = np.minimum(o, shared)
        both = (v.at[probe[of]] < v.size[x] - o + s) & (post_at[place] < n.size[y] - o + s)
        pair, met = np.unique(x[both] * len(names) + y[both], return_counts=True)
        x, y = pair // max(len(names), 1), pair % max(len(names), 1)
        o = np.ceil((v.size[x] + n.size[y]) * (near / (1 + near)) - _EPS).astype(np.int64)
        keep = met >= np.minimum(o, shared)
        x, y = x[keep], y[keep]
        compared += len(x)
        cut = _parts(v.size[x], POSTINGS_AT_ONCE)
        for c, e in zip(cut, cut[1:], strict=False):
            i, j = x[c:e], y[c:e]
            total = max(len(codes), 1)
            p1, t1 = _spread(v.start[i], v.size[i])
            p2, t2 = _spread(n.start[j], n.size[j])
            seen = v.rank[t1] >= 0
            mine = np.isin(p1[seen] * total + v.rank[t1][seen], p2 * total + n.rank[t2], assume_unique=True)
            common = np.bincount(p1[seen][mine], minlength=len(i))
            jaccard = common / (v.size[i] + n.size[j] - common)
            good = jaccard >= near - _EPS
            out.append((i[good], j[good], jaccard[good]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), compared
    return *(np.concatenate(c) for c in zip(*out, strict=True)), compared


# ---------------------------------------------------------------- the join over all cells
def _cells(left: DataFrame, right: DataFrame) -> tuple:
    """Both sides grouped by cell, and the token counts of all names beside the names that have the token first."""
    spark = left.sparkSession
    shards = max(1, math.ceil(right.count() / NAMES_A_SHARD))
    blocks = max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark), math.ceil(left.count() / VALUES_A_BLOCK))
    part = lambda k: F.pmod(F.xxhash64("form"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    pad = F.concat(F.lit(" "), "form", F.lit(" "))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("form") + 1), lambda i: F.substring(pad, i, F.lit(2))))
    tokens = right.select("form", part(shards).alias("shard"), F.explode(grams).alias("t"))
    # A shard's names need the counts, over all names, of the tokens that stand in the shard.
    counts = tokens.groupBy("t", "shard").count().groupBy("t").agg(F.sum("count").alias("n"), F.collect_list("shard").alias("in"))
    names = right.select("form", F.lit(None).cast("long").alias("n"), part(shards).alias("shard")).unionByName(counts.select(F.col("t").alias("form"), "n", F.explode("in").alias("shard")))
    l = left.select("form", part(blocks).alias("block"), every(shards).alias("shard"))
    r = materialize(names, "names").withColumn("block", every(blocks))
    # Comparing costs far more than reading, so tasks are set by cells, not by the few bytes that hold them.
    return tuple(df.repartition(shards * blocks, "shard", "block").groupBy("shard", "block") for df in (l, r))


def _joined(left: DataFrame, right: DataFrame, near: float, best: bool) -> DataFrame:
    by_value, by_name = _cells(left, right)
    schema = pa.schema([("form", pa.string()), ("other", pa.string()), ("jaccard", pa.float64())])

    def cell(values: pa.Table, names: pa.Table) -> pa.Table:
        forms, listed, n = (c.to_pylist() for c in (values["form"], names["form"], names["n"]))
        entries = [f for f, k in zip(listed, n, strict=True) if k is None]
        rarity = {ord(t[0]) << 32 | ord(t[1]): k for t, k in zip(listed, n, strict=True) if k is not None}
        x, y, j, _ = near_pairs(forms, entries, rarity, near)
        if best and len(x):
            # All names as close as the closest, so that ties can be told apart by their keys later.
            top = np.zeros(len(forms))
            np.maximum.at(top, x, j)
            keep = j >= top[x] - _EPS
            x, y, j = x[keep], y[keep], j[keep]
        return pa.table([[forms[i] for i in x], [entries[i] for i in y], j], schema=schema)

    return by_value.cogroup(by_name).applyInArrow(cell, "form string, other string, jaccard double")


def similar(left: DataFrame, right: DataFrame, near: float = NEAR) -> DataFrame:
    """``form, other, jaccard``: the pairs of forms whose token sets have Jaccard similarity ``near`` or more; all of them.

    Both sides have ``form``, distinct and not NULL. A prefix-filter join with tokens ordered by how many names have
    them, see :func:`near_pairs`. It runs in a grid: blocks of values by shards of names, so every cell is of bounded
    size whatever its tokens are, and a token in a third of all names makes no task larger than the others. Nothing is
    broadcast or collected. Values are sent once per shard and names once per block.
    """
    return _joined(left, right, near, best=False)


def closest(values: DataFrame, value: str, names: DataFrame, near: float = NEAR) -> DataFrame:
    """``value, key, similarity``: the entry each distinct value means; NULL key where no name is near.

    ``names`` comes from :func:`reference_names`. A value whose form is a name has similarity 1. Otherwise the name of
    greatest Jaccard similarity from ``near`` on wins; ties go to the least key. Values without letters or digits have
    NULL key. NULL values give no row. Texts of any length are compared whole.
    """
    texts = materialize(values.select(F.col(value).alias("value")).where("value IS NOT NULL").distinct().withColumn("form", form_udf("value")), "texts")
    forms = materialize(texts.select("form").where("form <> ''").distinct().join(names, "form", "left"), "forms")
    exact = forms.where("key IS NOT NULL").select("form", "key", F.lit(1.0).alias("similarity"))
    pairs = _joined(forms.where("key IS NULL"), names, near, best=True)
    named = pairs.join(names.withColumnRenamed("form", "other"), "other")
    best = named.groupBy("form").agg(F.min(F.struct((-F.round("jaccard", 9)).alias("s"), "key")).alias("b")).select("form", "b.key", (-F.col("b.s")).alias("similarity"))
    return texts.join(exact.unionByName(best), "form", "left").select(F.col("value").alias(value), "key", "similarity")
