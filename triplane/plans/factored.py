"""Aggregates over products of relations, made from each side's own instead of from the pairs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..sources.store import Rel, text_of, widened
from .expressions import Scope, evaluate
from .sparql import Call, Var, walk

_ROWS = "_rows"


@dataclass
class Part:
    """A column of partial results. ``merge`` joins those of several groups; ``weighted``: a row counts as often as it
    is paired."""

    of: Column
    merge: Column
    weighted: bool


def factored(rel: Rel, keys: list[str], calls: dict[str, Call]) -> DataFrame | None:
    """The keys and each aggregate of ``calls`` under its name, as grouping ``rel`` gives them; None unless a part of
    ``rel`` is a product and all aggregates can be merged (averages of decimals, and sums with more than 6 digits after
    the point, can't be without other rounding).

    A side is grouped by its own keys with its number of rows, so the pairs are never made; an aggregate over variables
    of both sides needs them, and there the product is made after all.
    """
    if not _products(rel) or any(c.distinct or c.name not in ("count", "sum", "avg", "min", "max", "sample") for c in calls.values()):
        return None
    numbers = [(c.name, rel.df.select(evaluate(c.args[0], Scope(rel)).num()).schema[0].dataType) for c in calls.values() if c.name in ("sum", "avg")]
    if any(isinstance(t, DecimalType) and (name == "avg" or t.scale > 6) for name, t in numbers):
        return None
    types = {f.name: f.dataType for f in _grouped(rel, keys, calls).schema}
    got = _merged(_partial(rel, keys, calls, rel, types), keys, calls, rel)
    return got.select(*[c for k in keys for c in rel.columns(k)], *[_final(n, c, rel).alias(n) for n, c in calls.items()])


def _products(rel: Rel) -> bool:
    return rel.product is not None or any(_products(p) for p in rel.parts or [])


def _read(call: Call) -> set[str]:
    return {x.name for x in walk(call.args) if isinstance(x, Var)} if call.args != ["*"] else set()


def _parts(name: str, call: Call, rel: Rel) -> dict[str, Part]:
    """The partial results an aggregate is made from."""
    if call.args == ["*"]:
        return {name: Part(F.count(F.lit(1)), F.sum(name), True)}
    v = evaluate(call.args[0], Scope(rel))
    if call.name == "count":
        return {name: Part(F.count(v.column), F.sum(name), True)}
    if call.name == "sum":
        return {name: Part(F.sum(v.num()), F.sum(name), True)}
    if call.name == "avg":
        return {f"{name}_s": Part(F.sum(v.num().cast("double")), F.sum(f"{name}_s"), True), f"{name}_c": Part(F.count(v.num()), F.sum(f"{name}_c"), True)}
    pick, by = (F.max, F.max_by) if call.name == "max" else (F.min, F.min_by)
    plain = {name: Part(pick(v.column), pick(name), False)}
    if v.kind != "any" or call.name == "sample":
        return plain
    for tag, order in (("n", v.num()), ("t", v.time())):
        held, at = f"{name}_{tag}", f"{name}_{tag}_at"
        plain |= {held: Part(by(v.column, order), by(held, at), False), at: Part(pick(order), pick(at), False)}
    return plain


def _final(name: str, call: Call, rel: Rel) -> Column:
    if call.name == "count":
        return F.coalesce(F.col(name), F.lit(0).cast("bigint"))
    if call.name == "avg":
        return F.try_divide(f"{name}_s", F.col(f"{name}_c"))
    return F.coalesce(*[F.col(n) for n in (f"{name}_n", f"{name}_t", name) if n in _parts(name, call, rel)])


def _all_parts(calls: dict[str, Call], rel: Rel) -> dict[str, Part]:
    return {n: p for name, call in calls.items() for n, p in _parts(name, call, rel).items()}


def _by(df: DataFrame, columns: list[str], aggs: list[Column]) -> DataFrame:
    return df.groupBy(*columns).agg(*aggs) if columns else df.agg(*aggs)


def _grouped(rel: Rel, keys: list[str], calls: dict[str, Call]) -> DataFrame:
    aggs = [p.of.alias(n) for n, p in _all_parts(calls, rel).items()]
    return _by(rel.df, [c for k in keys if k in rel.info for c in rel.columns(k)], [F.count(F.lit(1)).alias(_ROWS), *aggs])


def _merged(df: DataFrame, keys: list[str], calls: dict[str, Call], whole: Rel) -> DataFrame:
    aggs = [p.merge.cast(df.schema[n].dataType).alias(n) for n, p in _all_parts(calls, whole).items()]
    return _by(df, [c for k in keys for c in whole.columns(k)], [F.coalesce(F.sum(_ROWS), F.lit(0)).alias(_ROWS), *aggs])


def _partial(rel: Rel, keys: list[str], calls: dict[str, Call], whole: Rel, types: dict) -> DataFrame:
    """Keys, number of rows and partial results of ``rel``, in the forms and types that ``whole`` has."""
    if rel.parts and _products(rel):
        found = reduce(DataFrame.unionByName, [_partial(p, keys, calls, whole, types) for p in rel.parts])
    elif rel.product and (sides := _sides(rel, calls)):
        found = _paired(rel, keys, sides, whole, types)
    else:
        found = _grouped(_conformed(rel, whole), keys, calls)
    wanted = [_ROWS, *[c for k in keys for c in whole.columns(k)], *_all_parts(calls, whole)]
    return found.select(*[(F.col(c) if c in found.columns else F.lit(None)).cast(types[c]).alias(c) for c in wanted])


def _sides(rel: Rel, calls: dict[str, Call]) -> tuple[dict[str, Call], dict[str, Call]] | None:
    """The aggregates of the left and of the right side; None if one reads both."""
    a, b, _ = rel.product
    left = {n: c for n, c in calls.items() if not _read(c) & set(b.info)}
    right = {n: c for n, c in calls.items() if n not in left}
    return None if any(_read(c) & set(a.info) for c in right.values()) else (left, right)


def _paired(rel: Rel, keys: list[str], sides: tuple[dict[str, Call], dict[str, Call]], whole: Rel, types: dict) -> DataFrame:
    a, b, how = rel.product
    made = []
    for side, calls in zip((a, b), sides, strict=True):
        own = [k for k in keys if k in side.info]
        one = _merged(_partial(side, own, calls, whole, types), own, calls, whole)
        made.append(one.where(F.col(_ROWS) > 0) if side is a or how == "inner" else one)
    x, y = made[0].withColumnRenamed(_ROWS, "_a_rows"), made[1].withColumnRenamed(_ROWS, "_b_rows")
    # without keys a side is one row
    df = x.join(y if any(k in b.info for k in keys) else F.broadcast(y), F.lit(True), how)
    times = (F.greatest(F.coalesce("_b_rows", F.lit(1)), F.lit(1)), F.col("_a_rows"))
    scaled = {n: (F.col(n) * by).cast(types[n]) for by, calls in zip(times, sides, strict=True) for n, p in _all_parts(calls, whole).items() if p.weighted}
    return df.withColumns({**scaled, _ROWS: F.col("_a_rows") * times[0]})


def _conformed(rel: Rel, whole: Rel) -> Rel:
    """The variables in the forms the union has for them."""
    for n, y in whole.info.items():
        x = rel.info.get(n)
        if x and y.kind == "any":
            rel = widened(rel, n)
        elif x and x.kind == "iri" and x.template != y.template:
            rel = Rel(rel.df.withColumn(n, text_of(x, F.col(n))), {**rel.info, n: y})
    return rel
