"""The names of nodes as a table: built by Spark, looked up by Spark."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import statistics as st
from ..functions.terms import local_name_of
from ..functions.text import jaccard_col, normalize, normalize_col, trigrams_col
from ..operators.retrieval import nearest_vectors, trigram_matches
from ..runtime import materialize
from ..sources.store import TYPE

# How far a kind of name is trusted, classes of people, and names of a country's people and things.
TRUST = {"primary": 1.0, "alternative": 0.92, "stripped": 0.85, "demonym": 0.8, "surname": 0.6}
PERSON_CLASSES = ("Person", "Human", "Employee")
DEMONYMS = {
    "Afghanistan": ["Afghan"], "Argentina": ["Argentine", "Argentinian"], "Australia": ["Australian"], "Austria": ["Austrian"], "Belgium": ["Belgian"], "Brazil": ["Brazilian"], "Canada": ["Canadian"],
    "Chile": ["Chilean"], "China": ["Chinese"], "Colombia": ["Colombian"], "Cuba": ["Cuban"], "Czech Republic": ["Czech"], "Czechoslovakia": ["Czechoslovak"], "Denmark": ["Danish"], "Egypt": ["Egyptian"],
    "Finland": ["Finnish"], "France": ["French"], "Germany": ["German"], "Greece": ["Greek"], "Hong Kong": ["Hong Kong"], "Hungary": ["Hungarian"], "Iceland": ["Icelandic"], "India": ["Indian"],
    "Indonesia": ["Indonesian"], "Iran": ["Iranian"], "Ireland": ["Irish"], "Israel": ["Israeli"], "Italy": ["Italian"], "Japan": ["Japanese"], "Mexico": ["Mexican"], "Netherlands": ["Dutch"],
    "New Zealand": ["New Zealand"], "Nigeria": ["Nigerian"], "Norway": ["Norwegian"], "Pakistan": ["Pakistani"], "Peru": ["Peruvian"], "Philippines": ["Filipino", "Philippine"], "Poland": ["Polish"],
    "Portugal": ["Portuguese"], "Romania": ["Romanian"], "Russia": ["Russian"], "Soviet Union": ["Soviet"], "South Africa": ["South African"], "South Korea": ["South Korean", "Korean"], "Spain": ["Spanish"],
    "Sweden": ["Swedish"], "Switzerland": ["Swiss"], "Taiwan": ["Taiwanese"], "Thailand": ["Thai"], "Turkey": ["Turkish"], "Ukraine": ["Ukrainian"],
    "United Kingdom": ["British", "English", "Scottish", "Welsh"], "United States": ["American", "US"], "Venezuela": ["Venezuelan"], "Vietnam": ["Vietnamese"],
}

#: Bytes up to which names with their best nodes are broadcast; above, names and n-grams are both shuffled.
BROADCAST_NAMES = 16 << 20


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


def entity_records(quads: DataFrame, label_predicates: list[str], type_predicate: str = TYPE) -> DataFrame:
    """``iri, label, labels, types, module, value_of, popularity``: nodes with a label, and few-valued texts as nodes."""
    named = st.labels(quads, label_predicates)
    kinds = quads.where((F.col("p") == type_predicate) & (F.col("o_kind") == 0)).groupBy(F.col("s").alias("iri")).agg(F.array_sort(F.collect_set("o")).alias("types"))
    nodes = named.join(kinds, "iri", "left").join(st.popularity(quads), "iri", "left").select("iri", "label", "labels", F.coalesce("types", F.array().cast("array<string>")).alias("types"), F.col("g").alias("module"), F.lit(None).cast("string").alias("value_of"), F.coalesce("popularity", F.lit(0)).alias("popularity"))
    values = st.value_entities(quads, tuple(label_predicates)).select(F.concat(F.lit("value:"), "p", F.lit("#"), "value").alias("iri"), F.col("value").alias("label"), F.array().cast("array<string>").alias("labels"), F.array().cast("array<string>").alias("types"), F.col("g").alias("module"), F.col("p").alias("value_of"), F.lit(0).cast("bigint").alias("popularity"))
    return nodes.unionByName(values)


def alias_table(records: DataFrame) -> DataFrame:
    """``norm, iri, trust``: every name of every record in normal form, with the best trust it has."""
    spark = records.sparkSession
    own = F.array(F.struct(F.col("label").alias("name"), F.lit(TRUST["primary"]).alias("trust")))
    others = F.transform("labels", lambda n: F.struct(n.alias("name"), F.lit(TRUST["alternative"]).alias("trust")))
    base = records.select("iri", "types", "label", "value_of", F.explode(F.concat(own, others)).alias("n")).select("iri", "types", "label", "value_of", "n.name", "n.trust")
    bare = F.regexp_replace("name", r"\s*\([^)]*\)\s*$", "")
    stripped = base.where((bare != F.col("name")) & (bare != "")).select("iri", "types", "label", "value_of", bare.alias("name"), F.lit(TRUST["stripped"]).alias("trust"))
    named = base.unionByName(stripped)
    people = spark.createDataFrame([(normalize(c), d) for c, ds in DEMONYMS.items() for d in ds], "country string, name string")
    of = named.where("value_of IS NULL").withColumn("country", normalize_col(F.col("name"))).drop("name", "trust").join(F.broadcast(people), "country").select("iri", "name", F.lit(TRUST["demonym"]).alias("trust"))  # a fixed list
    words = F.split(F.regexp_replace("label", r"\s*\([^)]*\)\s*$", ""), r"\s+")
    last = F.try_element_at(words, F.lit(-1))
    person = F.exists("types", lambda t: local_name_of(t).isin(*PERSON_CLASSES))
    surname = records.where(F.col("value_of").isNull() & person & F.size(words).between(2, 4) & last.rlike(r"^\p{Lu}\p{L}{3,}$")).select("iri", last.alias("name"), F.lit(TRUST["surname"]).alias("trust"))
    every = named.select("iri", "name", "trust").unionByName(of).unionByName(surname)
    return every.select(normalize_col(F.col("name")).alias("norm"), "iri", "trust").where("norm <> ''").groupBy("norm", "iri").agg(F.max("trust").alias("trust"))


class EntityIndex:
    """Records and their names. Lookups are Spark filters on the alias table; nothing of it is held on the driver."""

    def __init__(self, records: DataFrame, aliases: DataFrame | None = None, embedder: Embedder | None = None) -> None:
        """``embedder`` turns names into vectors for :meth:`nearest`; without one that finds nothing."""
        self.records, self.embedder = records, embedder
        self.aliases = alias_table(records) if aliases is None else aliases

    def save(self, path: str) -> None:
        self.records.write.mode("overwrite").parquet(f"{path}/records")
        self.aliases.write.mode("overwrite").parquet(f"{path}/aliases")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EntityIndex:
        return cls(spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/aliases"))

    def exact(self, norms: list[str], most: int = 20) -> DataFrame:
        """``norm, trust, score`` and the record of each node so named, the best ``most`` per name. Popular nodes first."""
        return self._ranked(self.aliases.where(F.col("norm").isin(norms)), most)

    def named(self, norms: DataFrame, most: int = 20) -> DataFrame:
        """:meth:`exact` for a table of names, its column ``norm``, in one join."""
        return self._ranked(self.aliases.join(norms.select("norm").distinct(), "norm", "left_semi"), most)

    def _ranked(self, aliases: DataFrame, most: int) -> DataFrame:
        hits = aliases.join(self.records, "iri")
        scored = hits.withColumn("score", F.col("trust") + 0.04 * F.log10(1 + F.col("popularity")))
        w = Window.partitionBy("norm").orderBy(F.col("score").desc(), "iri")
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)

    def fuzzy(self, text: str, least: float = 0.72, k: int = 5) -> DataFrame:
        """Records with a trusted name alike by trigrams."""
        t = trigrams_col(F.lit(text))
        names = self.aliases.where(F.col("trust") >= TRUST["stripped"])
        alike = names.withColumn("similarity", jaccard_col(t, trigrams_col(F.col("norm")))).where(F.col("similarity") >= least)
        return alike.join(self.records, "iri").withColumn("score", F.col("similarity") * 0.9).orderBy(F.col("score").desc(), "iri").limit(k)


    def nearest(self, text: str, least: float = 0.8, k: int = 5) -> list[dict]:
        """Records with a trusted name near in meaning, by the cosine of vectors; none without an embedder."""
        if self.embedder is None:
            return []
        embed, floats = self.embedder, "array<double>"
        names = self.aliases.where(F.col("trust") >= TRUST["stripped"]).select("norm").distinct()

        @F.pandas_udf(floats)
        def vectors(norm: pd.Series) -> pd.Series:
            return pd.Series([list(map(float, v)) for v in embed.embed(norm.tolist())])

        asked = names.sparkSession.createDataFrame([(0, list(map(float, embed.embed([normalize(text)])[0])))], f"q int, v {floats}")
        near = nearest_vectors(names.withColumn("v", vectors("norm")), "norm", "v", asked, "q", k, least)
        got = near.join(self.aliases, "norm").join(self.records, "iri").withColumn("score", F.col("cosine") * 0.9)
        return [r.asDict() for r in got.select("iri", "label", "types", "module", "value_of", "score").orderBy(F.desc("score"), "iri").limit(k).collect()]


def link_mentions(questions: DataFrame, question_id: str, question: str, index: EntityIndex, longest: int = 8, schema_terms: Sequence[str] = ()) -> DataFrame:
    """Batch linking: ``question_id, start, words, norm, iri, score`` of every name that stands in a question, the best
    node of each, longer names first where they overlap.

    Word n-grams join the alias table by equality, else without a final s (not where that makes the last of several
    words one of ``schema_terms``); overlaps are settled within a question, whose n-grams are few. Then each run of
    capitalised words that no name covers, the question's first word aside, takes the name most alike by trigrams;
    ``norm`` is the name found.

    The names, the best node of each, the spans that have one and the runs without one are each written once: every
    later step reads files, so no plan holds the making of another. What grows with the questions is never broadcast:
    Spark takes a question's n-grams and a file's texts for as small as the file they come from, so their joins say how
    they are made. Names are broadcast up to BROADCAST_NAMES, measured.
    """
    aliases = materialize(index.aliases, "aliases")
    words = F.split(normalize_col(F.col(question)), " ")
    grams = questions.select(F.col(question_id).alias("qid"), words.alias("w")).where("w IS NOT NULL AND w[0] <> ''")
    at = grams.select("qid", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("start"))
    spans = at.select("qid", "start", "w", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("start")))).alias("n"))
    named = spans.select("qid", "start", F.col("n").alias("words"), F.array_join(F.slice("w", F.col("start") + 1, F.col("n")), " ").alias("norm"))
    best = aliases.hint("merge").join(index.records.select("iri", "popularity"), "iri").withColumn("score", F.col("trust") + 0.04 * F.log10(1 + F.col("popularity"))).groupBy("norm").agg(F.max(F.struct("score", "iri")).alias("b"))
    best = materialize(best, "best")
    held = best.agg(F.sum(F.octet_length("norm") + F.octet_length("b.iri") + 100).alias("n")).first()["n"] or 0
    best = F.broadcast(best) if held <= BROADCAST_NAMES else best.hint("merge")
    singular = F.expr("substr(norm, 1, length(norm) - 1)")
    plural = F.col("norm").endswith("s") & (F.length("norm") > 4) & ~((F.col("words") > 1) & F.element_at(F.split(singular, " "), -1).isin(*schema_terms))
    forms = named.select("qid", "start", "words", F.col("norm").alias("as_is"), F.explode(F.when(plural, F.array("norm", singular)).otherwise(F.array("norm"))).alias("norm"))
    hits = forms.join(best, "norm").select("qid", "start", "words", (F.col("norm") != F.col("as_is")).alias("bent"), "norm", F.col("b.iri").alias("iri"), F.col("b.score").alias("score"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("words")).alias("neg"), "start", "bent", "words", "norm", "iri", "score")))
    free = lambda kept, x: ~F.exists(kept, lambda y: (x["start"] < y["start"] + y["words"]) & (y["start"] < x["start"] + x["words"]))
    per = hits.groupBy("qid").agg(ordered.alias("all"))
    empty = F.slice("all", 1, 0)
    chosen = F.aggregate("all", empty, lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    exact = materialize(per.select("qid", F.explode(chosen).alias("m")).select("qid", "m.start", "m.words", "m.norm", "m.iri", "m.score"), "exact")
    covers = exact.groupBy("qid").agg(F.collect_set(F.struct("start", "words")).alias("covers"))
    raw = questions.select(F.col(question_id).alias("qid"), F.filter(F.split(question, r"\s+"), lambda w: w != "").alias("raw")).where("qid IS NOT NULL AND raw IS NOT NULL")
    counts = F.transform(F.transform("raw", normalize_col), lambda n: F.when(n == "", 0).otherwise(F.size(F.split(n, " "))))
    runs = raw.withColumn("counts", counts).join(covers.hint("merge"), "qid", "left").select("qid", F.explode(F.udf(_runs, "array<struct<start: int, words: int, text: string>>", useArrow=True)("raw", "counts", "covers")).alias("r")).select("qid", "r.*").distinct()
    runs = materialize(runs, "runs")
    trusted = aliases.where(F.col("trust") >= TRUST["stripped"])
    near = trigram_matches(runs, "text", trusted, "norm", k=50).select(F.col("query").alias("text"), F.col("name").alias("norm"), "similarity").join(trusted.groupBy("norm").agg(F.min("iri").alias("iri")), "norm")
    top = near.groupBy("text").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "iri", "norm")).alias("b"))
    fuzzy = runs.hint("merge").join(top, "text").select("qid", "start", "words", "b.norm", "b.iri", (F.col("b.far") * -0.9).alias("score"))
    return exact.unionByName(fuzzy).withColumnRenamed("qid", question_id)


def _runs(raw: list, counts: list, covers: list | None) -> list:
    """Runs of capitalised words, or words with digits after one, that no name covers; places count normalised words."""
    used = {i for c in covers or [] for i in range(c["start"], c["start"] + c["words"])}
    out: list = []
    at, run = 0, None
    for word, n in zip(raw, counts, strict=True):
        if not n:
            continue
        free = at > 0 and used.isdisjoint(range(at, at + n))
        bare = word if not free or word.isalnum() else word.strip("".join(c for c in word if not c.isalnum()))
        if free and (bare[:1].isupper() or run and any(c.isdigit() for c in bare)):
            run = run or (at, [])
            run[1].append((n, bare))
        elif run:
            out.append(run)
            run = None
        at += n
    return [(start, sum(n for n, _ in ws), " ".join(w for _, w in ws)) for start, ws in [*out, *([run] if run else [])]]
