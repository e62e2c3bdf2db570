"""Queries on the catalog, on names of nodes, and on forms of text and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog.cards import Catalog, build_catalog
from ..catalog.paths import SchemaGraph
from ..evaluation.metrics import answer_value
from ..functions.terms import Prefixes, local_name_of
from ..functions.text import approx_tokens_col, bigrams_col, tokens_col
from ..runtime import materialize, read_table
from ..sources import testgraph as tg
from ..sources.quads import graph_counts
from .catalog import _ALL, _COLUMNS, _SIZES
from .graph import G, O
from .text import _words

QUERIES, SQL = {}, {}


def _quads(spark: SparkSession, d: str) -> DataFrame:
    return tg.store(spark, d).quads()


def _catalog(spark: SparkSession, d: str) -> Catalog:
    return build_catalog(materialize(_quads(spark, d), "quads"))


def module_counts(spark: SparkSession, d: str) -> DataFrame:
    """Statements of every graph."""
    return graph_counts(_quads(spark, d))


def catalog_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class cards of a catalog built over the whole store."""
    rows = [(c.iri, c.instances, c.module) for c in _catalog(spark, d).classes.values()]
    return spark.createDataFrame(rows, "class string, instances long, module string")


def catalog_properties(spark: SparkSession, d: str) -> DataFrame:
    """The property cards: kind, uses, home module, domains and ranges."""
    rows = [(p.iri, p.kind, p.uses, p.module, ",".join(sorted(p.domains)), ",".join(sorted(p.ranges))) for p in _catalog(spark, d).properties.values()]
    return spark.createDataFrame(rows, "p string, kind string, uses long, module string, domains string, ranges string")


def schema_edges(spark: SparkSession, d: str) -> DataFrame:
    """All hops between classes, and to attributes, that the catalog gives."""
    graph = SchemaGraph(_catalog(spark, d))
    rows = sorted({(e.src, e.kind, e.prop, e.dst) for c in graph.cat.classes for e in graph.edges(c)}, key=str)
    return spark.createDataFrame(rows, "src string, kind string, p string, dst string")


def paths_to_region(spark: SparkSession, d: str) -> DataFrame:
    """How many ways of at most three hops lead from each class to the regions, and the hops of the shortest."""
    graph = SchemaGraph(_catalog(spark, d))
    ways = {c: graph.paths_between(c, O + "Region") for c in graph.cat.classes if c != O + "Region"}
    return spark.createDataFrame([(c, len(w), len(w[0].edges)) for c, w in ways.items() if w], "class string, ways int, shortest int")


def compact_names(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that orders point at, with prefixes and by their local names."""
    nodes = _quads(spark, d).where(F.col("p") == O + "placedBy").select("o").distinct()
    return Prefixes({"t": O, "c": f"{tg.ID}customer/", "id": tg.ID}).compact_all(nodes, "o", "short").select(F.col("o").alias("iri"), "short", local_name_of(F.col("o")).alias("name"))


def bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring words of whole texts."""
    words = tokens_col(F.col("text"))
    return read_table(spark, d, "documents").select(F.explode(bigrams_col(words)).alias("b")).groupBy("b.a", "b.b").agg(F.count(F.lit(1)).alias("n"))


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens of whole texts per source."""
    return read_table(spark, d, "documents").where("text IS NOT NULL").groupBy("source").agg(F.sum(approx_tokens_col(F.col("text"))).alias("tokens"))


def answer_forms(spark: SparkSession, d: str) -> DataFrame:
    """Stated answers, prices and dates in the form in which answers are compared."""
    items = read_table(spark, d, "benchmark_item").select(F.explode("gold_answers").alias("v"))
    prices = read_table(spark, d, "part").select(F.col("p_retailprice").cast("string").alias("v"))
    days = read_table(spark, d, "sales_order").select(F.concat(F.col("order_date").cast("string"), F.lit("T00:00:00")).alias("v"))
    names = read_table(spark, d, "part").select(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")).alias("v"))
    every = items.unionByName(prices).unionByName(days).unionByName(names)
    return every.where("v IS NOT NULL").select(answer_value(F.col("v")).alias("form")).groupBy("form").agg(F.count(F.lit(1)).alias("n"))


for _f in (module_counts, catalog_classes, catalog_properties, schema_edges, paths_to_region, compact_names, bigram_counts, token_estimates, answer_forms):
    QUERIES[_f.__name__] = _f

_USED = _ALL.format(select="g, class, p, n, users, object")
_HOME = f"SELECT p, g FROM (SELECT p, g, row_number() OVER (PARTITION BY p ORDER BY sum(n) DESC, g) AS k FROM ({_USED}) WHERE n > 0 GROUP BY p, g) WHERE k = 1"
#: Classes of which a tenth or more uses a property, and those its objects have.
_DOMAINS = f"SELECT p, class FROM (SELECT class, p, users FROM ({_USED})) JOIN ({_SIZES}) USING (class) WHERE users > 0 AND users >= 0.1 * instances"
_RANGES = " UNION ".join(f"SELECT '{O}{p}' AS p, '{O}{to}' AS dst WHERE (SELECT count({c}) FROM {t}) > 0" for t, c, p, to in _COLUMNS if to)
_EDGES = f"""SELECT d.class AS src, CASE WHEN r.dst IS NULL THEN 'attribute' ELSE 'object' END AS kind, d.p, r.dst FROM dom d LEFT JOIN rng r ON r.p = d.p
  UNION SELECT r.dst, 'inverse', d.p, d.class FROM dom d JOIN rng r ON r.p = d.p"""
SQL.update(
    {
        "module_counts": f"SELECT g, sum(n)::BIGINT AS triples FROM (SELECT g, users AS n FROM ({_USED}) UNION ALL SELECT g, instances FROM ({_SIZES})) GROUP BY g",
        "catalog_classes": f"SELECT class, instances, g AS module FROM ({_SIZES})",
        "catalog_properties": f"""WITH u AS ({_USED}), dom AS ({_DOMAINS}), rng AS ({_RANGES}), h AS ({_HOME})
          SELECT p, CASE WHEN bool_or(object) THEN 'object' ELSE 'literal' END AS kind, sum(users)::BIGINT AS uses, any_value(h.g) AS module,
            (SELECT string_agg(DISTINCT class, ',' ORDER BY class) FROM dom WHERE dom.p = u.p) AS domains, coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM rng WHERE rng.p = u.p), '') AS ranges
          FROM u JOIN h USING (p) WHERE users > 0 GROUP BY p""",
        "schema_edges": f"WITH dom AS ({_DOMAINS}), rng AS ({_RANGES}) {_EDGES}",
        "paths_to_region": f"""WITH RECURSIVE dom AS ({_DOMAINS}), rng AS ({_RANGES}), e AS ({_EDGES}),
          w AS (SELECT src AS class, dst AS "at", [src, dst] AS seen, kind, p, 1 AS hops FROM e WHERE dst IS NOT NULL AND dst <> src AND src <> '{O}Region'
            UNION ALL SELECT w.class, e.dst, list_append(w.seen, e.dst), e.kind, e.p, hops + 1 FROM w JOIN e ON e.src = w."at"
              WHERE w."at" <> '{O}Region' AND e.dst IS NOT NULL AND NOT list_contains(w.seen, e.dst) AND hops < 3 AND NOT (e.p = w.p AND e.kind <> w.kind))
          SELECT class, count(*)::INTEGER AS ways, min(hops)::INTEGER AS shortest FROM w WHERE "at" = '{O}Region' GROUP BY class""",
        "compact_names": f"SELECT DISTINCT '{tg.ID}customer/' || o_custkey AS iri, 'c:' || o_custkey AS short, o_custkey::VARCHAR AS name FROM orders WHERE o_custkey IS NOT NULL",
        "bigram_counts": f"WITH w AS (SELECT {_words('text')} AS w FROM documents), b AS (SELECT w, unnest(range(1, len(w))) AS i FROM w) SELECT w[i] AS a, w[i + 1] AS b, count(*) AS n FROM b GROUP BY 1, 2",
        "token_estimates": "SELECT source, sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "answer_forms": """WITH v AS (SELECT unnest(gold_answers) AS v FROM benchmark_item UNION ALL SELECT p_retailprice::VARCHAR FROM part UNION ALL SELECT order_date::DATE::VARCHAR || 'T00:00:00' FROM sales_order UNION ALL SELECT '  ' || upper(p_name) || ' ' FROM part),
          n AS (SELECT v, round(TRY_CAST(v AS DOUBLE), 2) AS x FROM v WHERE v IS NOT NULL)
          SELECT CASE WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$') THEN left(v, 10) WHEN x = floor(x) THEN floor(x)::BIGINT::VARCHAR WHEN x IS NOT NULL THEN x::VARCHAR ELSE lower(trim(v)) END AS form, count(*) AS n FROM n GROUP BY 1""",
    }
)
