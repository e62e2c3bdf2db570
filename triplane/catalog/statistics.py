"""Statistics of quads, each a Spark aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..runtime import materialize
from ..sources.store import TYPE
from ..sources.turtle import XSD

#: The least share of a class's instances (or of the top range) that makes it a domain (range); the most
#: distinct values of a property that are entities of their own.
LEAST_SHARE, MOST_VALUES = 0.1, 200


def _types(quads: DataFrame, type_predicate: str = TYPE) -> DataFrame:
    return quads.where((F.col("p") == type_predicate) & (F.col("o_kind") == 0)).select("g", "s", F.col("o").alias("class")).distinct()


def predicate_counts(quads: DataFrame, type_predicate: str = TYPE) -> DataFrame:
    """``g, p, n, literals, objects, datatype``: uses of each predicate per graph, in one pass. Type statements aside."""
    rest = quads.where(F.col("p") != type_predicate)
    return rest.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_kind") == 1).alias("literals"), F.count_if(F.col("o_kind") != 1).alias("objects"), F.min("o_dt").alias("datatype"))


def class_counts(quads: DataFrame, type_predicate: str = TYPE) -> DataFrame:
    """``g, class, instances``."""
    return _types(quads, type_predicate).groupBy("g", "class").agg(F.count(F.lit(1)).alias("instances"))


def class_predicates(quads: DataFrame, type_predicate: str = TYPE) -> DataFrame:
    """``g, class, p, instances``: how many instances of a class use a predicate."""
    used = quads.where(F.col("p") != type_predicate).select("g", "s", "p").distinct()
    return used.join(_types(quads, type_predicate), ["g", "s"]).groupBy("g", "class", "p").agg(F.count(F.lit(1)).alias("instances"))


def object_classes(quads: DataFrame, type_predicate: str = TYPE) -> DataFrame:
    """``g, p, class, n``: uses of a predicate whose object is of a class, in whatever graph that is said."""
    kinds = _types(quads, type_predicate).select(F.col("s").alias("o"), "class").distinct()
    return quads.where((F.col("p") != type_predicate) & (F.col("o_kind") != 1)).select("g", "p", "o").join(kinds, "o").groupBy("g", "p", "class").agg(F.count(F.lit(1)).alias("n"))


def observed_domains(quads: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """``p, class, share``: classes of which at least that share uses the predicate."""
    return domains_of(class_predicates(quads), class_counts(quads), least)


def domains_of(uses: DataFrame, sizes: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """:func:`observed_domains` from tables of :func:`class_predicates` and :func:`class_counts`."""
    users = uses.groupBy("p", "class").agg(F.sum("instances").alias("users"))
    size = sizes.groupBy("class").agg(F.sum("instances").alias("instances"))
    return users.join(size, "class").select("p", "class", (F.col("users") / F.col("instances")).alias("share")).where(F.col("share") >= least)


def observed_ranges(quads: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """``p, class, n``: classes of objects at least that share as common as the predicate's most common one."""
    n = object_classes(quads).groupBy("p", "class").agg(F.sum("n").alias("n"))
    return n.withColumn("top", F.max("n").over(Window.partitionBy("p"))).where(F.col("n") >= least * F.col("top")).drop("top")


def home_graphs(quads: DataFrame) -> DataFrame:
    """``p, g``: the graph that uses the predicate most; the first by name on ties."""
    return predicate_counts(quads).groupBy("p").agg(F.min_by("g", F.struct(-F.col("n"), F.col("g"))).alias("g"))


def value_entities(quads: DataFrame, skip: tuple[str, ...] = (), most: int = MOST_VALUES) -> DataFrame:
    """``g, p, value``: the texts of properties that have at most so many different ones.

    Values are made distinct map-side; what is kept is known from the counts, before any value is gathered.
    """
    text = (F.col("o_kind") == 1) & ((F.col("o_dt") == XSD + "string") | F.col("o_lang").isNotNull())
    values = quads.where(text & ~F.col("p").isin(*skip) if skip else text).select("g", "p", F.col("o").alias("value")).distinct()
    few = values.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select("g", "p")
    return values.join(few, ["g", "p"], "left_semi")


def popularity(quads: DataFrame) -> DataFrame:
    """``iri, popularity``: statements that point at a node, in all graphs."""
    return quads.where("o_kind = 0").groupBy(F.col("o").alias("iri")).agg(F.count(F.lit(1)).alias("popularity"))


def labels(quads: DataFrame, predicates: list[str]) -> DataFrame:
    """``iri, label, labels, g``: a node's first label, by order of predicates then text, and its other labels.

    Only plain and English labels of IRIs count.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in predicates]), F.col("p"))
    english = F.coalesce(F.col("o_lang"), F.lit("")).rlike("^(en(-.*)?)?$")
    rows = quads.where(F.col("p").isin(*predicates) & (F.col("o_kind") == 1) & english & ~F.startswith("s", F.lit("_:"))).select("s", "g", "o", rank.alias("rank"))
    best = rows.groupBy(F.col("s").alias("iri")).agg(F.min(F.struct("rank", "o", "g")).alias("b"), F.collect_set("o").alias("all"))
    return best.select("iri", F.col("b.o").alias("label"), F.array_sort(F.array_remove(F.col("all"), F.col("b.o"))).alias("labels"), F.col("b.g").alias("g"))


def closure(edges: DataFrame) -> DataFrame:
    """``below, above``: every class with itself and all classes above it. Cycles end: known pairs aren't taken again.

    ``edges`` has ``below, above``. Each round joins what it found with all that is known, so ways of any length take a
    logarithmic number of rounds; it writes what it found, so plans stay short and executors may be lost.
    """
    e = edges.where("below IS NOT NULL AND above IS NOT NULL").select("below", "above").distinct()
    own = e.select(F.col("below").alias("c")).unionByName(e.select(F.col("above").alias("c"))).distinct().select(F.col("c").alias("below"), F.col("c").alias("above"))
    seen = materialize(own.unionByName(e).distinct(), "closure")
    fresh = e
    while not fresh.isEmpty():
        step = fresh.alias("a").join(seen.alias("b"), F.col("a.above") == F.col("b.below")).select("a.below", "b.above").distinct()
        fresh = materialize(step.join(seen, ["below", "above"], "left_anti"), "closure")
        seen = seen.unionByName(fresh)
    return seen


def instance_rollup(quads: DataFrame, edges: DataFrame) -> DataFrame:
    """``class, instances``: instances of a class and of all below it, each node once."""
    up = closure(edges)
    kinds = _types(quads).select("s", "class").distinct()
    lifted = kinds.join(up, F.col("class") == F.col("below"), "left").select("s", F.coalesce("above", "class").alias("class")).distinct()
    return lifted.groupBy("class").agg(F.count(F.lit(1)).alias("instances"))


def shared_values(quads: DataFrame, a: str, b: str) -> DataFrame:
    """``shared``: different values two predicates have in common."""
    pair = quads.sparkSession.createDataFrame([(a, b)], "a string, b string")
    return join_overlaps(quads, pair).agg(F.coalesce(F.sum("shared"), F.lit(0)).alias("shared"))


def join_overlaps(quads: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, shared``: different values the predicates of each pair have in common; all pairs in one job.

    A value's predicates are gathered once (as many as the schema pairs at most), and each of the pairs among them that
    are asked for counts one; pairs without a common value have no row.
    """
    asked = pairs.select("a", "b").distinct()
    either = asked.select(F.col("a").alias("p")).unionByName(asked.select(F.col("b").alias("p"))).distinct()
    values = quads.where(F.col("o_kind") == 1).select("p", "o").join(F.broadcast(either), "p", "left_semi")  # predicates of a schema
    users = values.groupBy("o").agg(F.collect_set("p").alias("ps")).where(F.size("ps") > 1)
    met = users.select("o", "ps", F.explode("ps").alias("a")).select("a", F.explode("ps").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return met.join(asked, ["a", "b"], "left_semi")


def sample_values(quads: DataFrame, k: int = 3) -> DataFrame:
    """``p, at, sample``: the least ``k`` different objects of each predicate, in one pass.

    A task keeps the least ``k`` of each predicate over all its rows, so at most k rows per task and predicate are
    shuffled, and a predicate with a third of all rows is never gathered or sorted.
    """
    schema = StructType.fromDDL("p string, o string")
    arrow = to_arrow_schema(schema)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = arrow.empty_table()
        for batch in batches:
            rows = pa.concat_tables([held, pa.Table.from_batches([batch]).cast(arrow)]).group_by(["p", "o"]).aggregate([]).sort_by([("p", "ascending"), ("o", "ascending")])
            place = np.arange(rows.num_rows)
            first = pc.run_end_encode(rows["p"].combine_chunks()).run_ends.to_numpy() if rows.num_rows else place
            start = np.repeat(np.concatenate(([0], first[:-1])), np.diff(first, prepend=0)) if rows.num_rows else place
            held = rows.filter(pa.array(place - start < k))
        yield from held.combine_chunks().to_batches()

    rest = quads.where((F.col("p") != TYPE) & F.col("o").isNotNull()).select("p", "o")
    found = rest.mapInArrow(least, schema).distinct()
    ranked = found.withColumn("at", F.row_number().over(Window.partitionBy("p").orderBy("o")) - 1)
    return ranked.where(F.col("at") < k).select("p", "at", F.col("o").alias("sample"))
