"""References to records that do not exist, are no longer listed, or were not listed yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space at either end of a stored link, Unicode spaces included.
_OUTER_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def link_key(link: Column, iri: bool) -> Column:
    """The form links are compared in: lower case, no outer white space, for IRIs without one enclosing ``< >``.

    NULL for NULL and for links with nothing left, which are no links.
    """
    key = F.regexp_replace(link, _OUTER_SPACE, "")
    if iri:
        key = F.regexp_replace(F.regexp_replace(key, r"^<(.*)>$", "$1"), _OUTER_SPACE, "")
    return F.nullif(F.lower(key), F.lit(""))


def dead_links(refs: DataFrame, parents: DataFrame, at: str, keep: list[str], start: str = "added_at", end: str = "removed_at") -> DataFrame:
    """The rows of ``refs`` whose ``key`` has no listing period in ``parents`` that holds the time ``at``.

    ``refs`` has ``key``, ``at`` and the columns ``keep``; ``parents`` has ``key`` and one row per listing period
    ``[start, end)``, ``end`` NULL while still listed. Returns ``keep`` and ``kind``: ``missing`` when no parent
    row has the key, ``late`` when its first ``start`` is after ``at``, else ``deleted``. Distinct rows.

    NULL keys are no links and give no row. A NULL ``at`` lies in no period: the row is a case, ``missing`` or
    ``deleted``. A parent row with NULL ``start`` lists nothing but makes the key known. Extra columns are ignored.

    Plan: the foreign keys are made distinct map-side before they meet the parent keys in a left anti join, so a
    hot key travels once per task. Records meet parents only in the period anti join and in the join back; both
    have the parents on the small side, which Spark broadcasts by measured size, and otherwise splits by AQE's skew
    handling. NULL keys are dropped first and never hash together.
    """
    r = refs.select(*keep, "key", F.col(at).alias("_at")).where("key IS NOT NULL").distinct()
    p = parents.select("key", F.col(start).alias("_from"), F.col(end).alias("_to")).where("key IS NOT NULL")
    first = p.groupBy("key").agg(F.min("_from").alias("_first"))
    orphans = r.select("key").distinct().join(first, "key", "left_anti").select("key", F.lit(True).alias("_orphan"))
    held = (F.col("r.key") == F.col("p.key")) & (F.col("r._at") >= F.col("p._from")) & (F.col("p._to").isNull() | (F.col("r._at") < F.col("p._to")))
    dead = r.alias("r").join(p.alias("p"), held, "left_anti")
    known = first.select("key", "_first", F.lit(False).alias("_orphan")).unionByName(orphans.select("key", F.lit(None).cast(first.schema["_first"].dataType).alias("_first"), "_orphan"))
    kind = F.when(F.col("_orphan"), "missing").when(F.col("_first") > F.col("_at"), "late").otherwise("deleted")
    return dead.join(known, "key").select(*keep, kind.alias("kind"))


def dead_link_counts(dead: DataFrame, refs: DataFrame, by: list[str]) -> DataFrame:
    """Per ``by``: links checked, and dead ones by kind. Groups without dead links are kept with zeros."""
    total = refs.groupBy(*by).agg(F.count(F.lit(1)).alias("links"))
    per = dead.groupBy(*by).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("missing", "late", "deleted")])
    on = None
    for c in by:
        same = total[c].eqNullSafe(per[c])
        on = same if on is None else on & same
    return total.join(per, on, "left").select(*[total[c] for c in by], "links", *[F.coalesce(F.col(k), F.lit(0)).alias(k) for k in ("missing", "late", "deleted")])
