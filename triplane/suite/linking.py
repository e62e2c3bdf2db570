"""Names and links over the test tables, RDF text written and read again, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_col
from ..linking.index import EntityIndex, alias_table, link_mentions
from ..runtime import read_table
from ..sources import testgraph as tg
from ..sources.quads import distinct_quads, normalize_lines, parse_lines, to_lines, typed
from .graph import G
from .text import _NORM

QUERIES, SQL = {}, {}
_COUNTRIES = ("France", "Germany", "Japan", "Atlantis")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Each entity once, with the names of all its listing periods; the rest is of the first."""
    e = read_table(spark, d, "entity")
    first = e.groupBy("iri").agg(F.min_by(F.struct("label", "types", "module", "value_of", "popularity"), "added_at").alias("r"))
    names = e.select("iri", F.explode(F.concat(F.array("label"), F.coalesce("labels", F.array().cast("array<string>")))).alias("n")).groupBy("iri").agg(F.array_sort(F.collect_set("n")).alias("labels"))
    return first.join(names, "iri", "left").select("iri", "r.label", F.array_remove("labels", F.col("r.label")).alias("labels"), "r.types", "r.module", "r.value_of", "r.popularity")


def aliases_of_every_kind(spark: SparkSession, d: str) -> DataFrame:
    """Names of which all kinds occur: customers as people with a first name and a town in brackets, nations under the
    names of countries."""
    c = read_table(spark, d, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("iri"), F.concat(F.lit("Ann "), F.initcap(F.translate(F.col("c_mktsegment"), "_-", "")), F.lit(" (town "), F.col("c_nationkey").cast("string"), F.lit(")")).alias("label"), F.array(F.lit("http://x/onto#Person")).alias("types"))
    n = read_table(spark, d, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("iri"), F.element_at(F.array(*[F.lit(x) for x in _COUNTRIES]), (F.col("n_nationkey") % len(_COUNTRIES) + 1).cast("int")).alias("label"), F.array().cast("array<string>").alias("types"))
    return alias_table(c.unionByName(n).withColumns({"labels": F.array().cast("array<string>"), "value_of": F.lit(None).cast("string")}))


def entity_aliases(spark: SparkSession, d: str) -> DataFrame:
    return alias_table(_records(spark, d))


def exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that mentions name, popular ones first; the names are looked up in one join."""
    wanted = read_table(spark, d, "mention").select(normalize_col(F.col("text")).alias("norm")).where("norm <> ''").distinct()
    return EntityIndex(_records(spark, d)).named(wanted).select("norm", "iri", "trust", F.round("score", 6).alias("score"), "rank")


def linked_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Every question's names, linked in one join."""
    return link_mentions(read_table(spark, d, "benchmark_item"), "row_id", "question", EntityIndex(_records(spark, d)))


def ntriples_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A graph written as lines and read again: the same statements."""
    quads = tg.store(spark, d, "customer", "nation", "region").quads()
    back = typed(distinct_quads(parse_lines(to_lines(quads, with_graph=True))))
    return back.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s", "o").alias("pairs"))


def normalized_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a datatype rewritten, repeats dropped."""
    lines = to_lines(tg.store(spark, d, "nation").quads())
    return normalize_lines(lines.unionByName(lines), {"http://www.w3.org/2001/XMLSchema#integer": "http://www.w3.org/2001/XMLSchema#long"})


for _f in (entity_aliases, aliases_of_every_kind, exact_lookup, linked_mentions, ntriples_roundtrip, normalized_lines):
    QUERIES[_f.__name__] = _f

_ALIASES = f"""r AS (SELECT iri, arg_min(struct_pack(label := label, popularity := popularity), added_at) AS r FROM entity GROUP BY 1),
  a AS (SELECT iri, r.popularity AS popularity, r.label AS name, 1.0 AS trust FROM r UNION ALL SELECT e.iri, r.popularity, unnest(list_prepend(e.label, coalesce(e.labels, []))), 0.92 FROM entity e JOIN r USING (iri)),
  n AS (SELECT {_NORM.format('name')} AS norm, iri, popularity, trust FROM a),
  t AS (SELECT norm, iri, max(popularity) AS popularity, max(trust)::DOUBLE AS trust FROM n WHERE norm <> '' GROUP BY 1, 2)"""
SQL.update(
    {
        "entity_aliases": f"WITH {_ALIASES} SELECT norm, iri, trust FROM t",
        "aliases_of_every_kind": f"""WITH c AS (SELECT 'c:' || c_custkey AS iri, upper(left(s, 1)) || lower(substr(s, 2)) AS last, 'town ' || c_nationkey AS town FROM (SELECT *, translate(c_mktsegment, '_-', '') AS s FROM customer)),
          n AS (SELECT 'n:' || n_nationkey AS iri, {list(_COUNTRIES)}[n_nationkey % {len(_COUNTRIES)} + 1] AS label FROM nation),
          v(label, people) AS (VALUES ('France', 'French'), ('Germany', 'German'), ('Japan', 'Japanese')),
          a AS (SELECT iri, 'Ann ' || last || ' ' || town AS name, 1.0 AS trust FROM c UNION ALL SELECT iri, 'Ann ' || last, 0.85 FROM c UNION ALL SELECT iri, last, 0.6 FROM c UNION ALL SELECT iri, label, 1.0 FROM n UNION ALL SELECT iri, people, 0.8 FROM n JOIN v USING (label))
          SELECT {_NORM.format('name')} AS norm, iri, max(trust)::DOUBLE AS trust FROM a GROUP BY 1, 2""",
        "normalized_lines": f"""SELECT DISTINCT value FROM (SELECT '<' || 'http://tables.example/id/nation/' || n_nationkey || '> <' || x.p || '> ' || x.o || ' .' AS value FROM nation, LATERAL (VALUES
          ('{tg.PREFIXES["rdf"]}type', '<{tg.ONTO}Nation>'), ('{tg.ONTO}name', '"' || n_name || '"'), ('{tg.ONTO}inRegion', '<http://tables.example/id/region/' || n_regionkey || '>')) x(p, o))""",
        "exact_lookup": f"""WITH {_ALIASES}, s AS (SELECT *, trust + 0.04 * log10(1 + popularity) AS score FROM t WHERE norm IN (SELECT {_NORM.format('text')} FROM mention)),
          k AS (SELECT norm, iri, trust, round(score, 6) AS score, row_number() OVER (PARTITION BY norm ORDER BY score DESC, iri) AS rank FROM s) SELECT * FROM k WHERE rank <= 20""",
        "ntriples_roundtrip": " UNION ALL ".join(
            f"SELECT '{G}{g}' AS g, '{p}' AS p, sum(n)::BIGINT AS n, sum(n)::BIGINT AS pairs FROM ({' UNION ALL '.join(f'SELECT count(*) AS n FROM {t}' for t in ts)})"
            for (g, p), ts in {
                ("party", tg.ONTO + "name"): ["customer"], ("party", tg.ONTO + "locatedIn"): ["customer"], ("party", tg.ONTO + "acctbal"): ["customer"], ("party", tg.ONTO + "segment"): ["customer"], ("party", tg.PREFIXES["rdf"] + "type"): ["customer"],
                ("geo", tg.ONTO + "name"): ["nation", "region"], ("geo", tg.ONTO + "inRegion"): ["nation"], ("geo", tg.PREFIXES["rdf"] + "type"): ["nation", "region"],
            }.items()
        ),
    }
)
