"""Statistics of the test tables read as a graph, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import statistics as st
from ..sources import testgraph as tg
from .graph import G, O, _id

QUERIES, SQL = {}, {}
PARTY = ("customer", "supplier", "nation", "region")


def _quads(spark: SparkSession, d: str, *tables: str) -> DataFrame:
    return tg.store(spark, d, *tables).quads()


def stats_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return st.class_counts(_quads(spark, d, *PARTY))


def stats_predicate_counts(spark: SparkSession, d: str) -> DataFrame:
    return st.predicate_counts(_quads(spark, d, *PARTY)).select("g", "p", "n", "literals", "objects")


def stats_class_predicates(spark: SparkSession, d: str) -> DataFrame:
    return st.class_predicates(_quads(spark, d, *PARTY))


def stats_domains_10pct(spark: SparkSession, d: str) -> DataFrame:
    """Half of the customers and a hundredth of the suppliers have a name: one class uses it enough, the other doesn't."""
    q = _quads(spark, d, *PARTY)
    key = F.regexp_extract("s", "([0-9]+)$", 1).cast("bigint")
    kept = ~F.col("p").isin(O + "name") | (F.contains("s", F.lit("/customer/")) & (key % 2 == 0)) | (F.contains("s", F.lit("/supplier/")) & (key % 100 == 0))
    return st.observed_domains(q.where(kept)).withColumn("share", F.round("share", 6))


def stats_ranges(spark: SparkSession, d: str) -> DataFrame:
    return st.observed_ranges(_quads(spark, d, *PARTY))


def stats_datatypes(spark: SparkSession, d: str) -> DataFrame:
    return st.predicate_counts(_quads(spark, d, "orders")).where("datatype IS NOT NULL").select("p", "datatype")


def home_module(spark: SparkSession, d: str) -> DataFrame:
    return st.home_graphs(_quads(spark, d, *PARTY))


def value_entities_le_200(spark: SparkSession, d: str) -> DataFrame:
    return st.value_entities(_quads(spark, d, "customer", "orders", "part"), (O + "name",))


def popularity_indegree(spark: SparkSession, d: str) -> DataFrame:
    return st.popularity(_quads(spark, d, "orders"))


def labels_first_by_priority(spark: SparkSession, d: str) -> DataFrame:
    return st.labels(_quads(spark, d, "customer"), [O + "segment", O + "name"]).select("iri", "label", F.concat_ws("|", "labels").alias("others"))


def instance_rollup(spark: SparkSession, d: str) -> DataFrame:
    edges = spark.createDataFrame([(O + a, O + b) for a, b in tg.SUBCLASSES.items()], "below string, above string")
    return st.instance_rollup(_quads(spark, d, *PARTY), edges)


def paths_closure(spark: SparkSession, d: str) -> DataFrame:  # noqa: ARG001
    rows = [(O + a, O + b) for a, b in [*tg.SUBCLASSES.items(), ("Party", "Thing"), ("Thing", "Party"), ("Record", "Thing")]]
    return st.closure(spark.createDataFrame(rows, "below string, above string"))


def schema_joins(spark: SparkSession, d: str) -> DataFrame:
    return st.shared_values(_quads(spark, d, "lineitem", "part"), O + "forPartCode", O + "partCode")


def sample_objects(spark: SparkSession, d: str) -> DataFrame:
    return st.sample_values(_quads(spark, d, "customer"))


for _f in (stats_class_counts, stats_predicate_counts, stats_class_predicates, stats_domains_10pct, stats_ranges, stats_datatypes, home_module, value_entities_le_200, popularity_indegree, labels_first_by_priority, instance_rollup, paths_closure, schema_joins, sample_objects):
    QUERIES[_f.__name__] = _f

_CLASSES = {t: (tg.TABLES[t][0], tg.TABLES[t][1]) for t in PARTY}
_USES = [(t, c, p, o) for t in PARTY for c, p, o in [(x.split(": ")[0], x.split(": ")[1].split(" > ")[0], " > " in x) for x in tg.TABLES[t][3].split(", ")]]
_COUNTED = " UNION ALL ".join(f"SELECT '{G}{_CLASSES[t][0]}' AS g, '{O}{_CLASSES[t][1]}' AS class, '{O}{p}' AS p, count({c}) AS n, {'0' if o else f'count({c})'} AS literals, {f'count({c})' if o else '0'} AS objects FROM {t}" for t, c, p, o in _USES)
SQL.update(
    {
        "stats_class_counts": " UNION ALL ".join(f"SELECT '{G}{g}' AS g, '{O}{c}' AS class, count(*) AS instances FROM {t}" for t, (g, c) in _CLASSES.items()),
        "stats_predicate_counts": f"SELECT g, p, sum(n)::BIGINT AS n, sum(literals)::BIGINT AS literals, sum(objects)::BIGINT AS objects FROM ({_COUNTED}) GROUP BY 1, 2",
        "stats_class_predicates": f"SELECT g, class, p, n AS instances FROM ({_COUNTED})",
        "stats_domains_10pct": f"WITH c AS ({_COUNTED}), s AS ("
        + " UNION ALL ".join(f"SELECT '{O}{_CLASSES[t][1]}' AS class, count(*) AS k FROM {t}" for t in PARTY)
        + f"""), u AS (SELECT class, p, n FROM c WHERE p <> '{O}name' UNION ALL SELECT '{O}Customer', '{O}name', count(*) FROM customer WHERE c_custkey % 2 = 0 AND c_name IS NOT NULL UNION ALL SELECT '{O}Supplier', '{O}name', count(*) FROM supplier WHERE s_suppkey % 100 = 0 AND s_name IS NOT NULL)
          SELECT p, class, round(n / k, 6) AS share FROM u JOIN s USING (class) WHERE n > 0 AND n >= 0.1 * k""",
        "stats_ranges": f"SELECT '{O}locatedIn' AS p, '{O}Nation' AS class, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT '{O}inRegion', '{O}Region', (SELECT count(*) FROM nation)",
        "stats_datatypes": " UNION ALL ".join(f"SELECT '{O}{p}' AS p, 'http://www.w3.org/2001/XMLSchema#{k}' AS datatype" for p, k in {"status": "string", "total": "double", "date": "dateTime", "priority": "string"}.items()),
        "home_module": f"SELECT p, arg_max(g, n) AS g FROM (SELECT g, p, sum(n) AS n FROM ({_COUNTED}) GROUP BY 1, 2) GROUP BY p",
        "value_entities_le_200": " UNION ALL ".join(f"SELECT DISTINCT '{G}{g}' AS g, '{O}{p}' AS p, {c} AS value FROM {t} WHERE (SELECT count(DISTINCT {c}) FROM {t}) <= 200" for t, g, c, p in [("customer", "party", "c_mktsegment", "segment"), ("orders", "sales", "o_orderstatus", "status"), ("orders", "sales", "o_orderpriority", "priority"), ("part", "catalog", "p_brand", "brand"), ("part", "catalog", "p_type", "partType")]),
        "popularity_indegree": f"SELECT {_id('Customer', 'o_custkey')} AS iri, count(*) AS popularity FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey UNION ALL SELECT '{O}Order', count(*) FROM orders",
        "labels_first_by_priority": f"SELECT {_id('Customer', 'c_custkey')} AS iri, c_mktsegment AS label, c_name AS others FROM customer",
        "instance_rollup": " UNION ALL ".join([*(f"SELECT '{O}{c}' AS class, count(*) AS instances FROM {t}" for t, (_, c) in _CLASSES.items()), f"SELECT '{O}Party', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)"]),
        "paths_closure": f"""WITH RECURSIVE e(below, above) AS (VALUES {', '.join(f"('{O}{a}', '{O}{b}')" for a, b in [*tg.SUBCLASSES.items(), ("Party", "Thing"), ("Thing", "Party"), ("Record", "Thing")])}),
          c AS (SELECT below, above FROM e UNION SELECT c.below, e.above FROM c JOIN e ON c.above = e.below), n AS (SELECT below AS x FROM e UNION SELECT above FROM e)
          SELECT below, above FROM c UNION SELECT x, x FROM n""",
        "schema_joins": "SELECT count(DISTINCT l_partkey) AS shared FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)",
        "sample_objects": 'SELECT p, "at", sample FROM (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY sample) - 1)::INT AS "at", sample FROM ('
        + " UNION ".join(f"SELECT '{O}{p}' AS p, {c} AS sample FROM customer WHERE {c} IS NOT NULL" for p, c in [("segment", "c_mktsegment"), ("name", "c_name"), ("locatedIn", _id("Nation", "c_nationkey")), ("acctbal", "c_acctbal::VARCHAR")])
        + ')) WHERE "at" < 3',
    }
)


# ---- the same over the whole store: every table of tg.TABLES, every predicate
WHOLE = {
    "stats_class_counts_all": st.class_counts,
    "stats_predicate_counts_all": lambda q: st.predicate_counts(q).select("g", "p", "n", "literals", "objects"),
    "stats_class_predicates_all": st.class_predicates,
    "stats_domains_10pct_all": lambda q: st.observed_domains(q).withColumn("share", F.round("share", 6)),
    "stats_ranges_all": st.observed_ranges,
    "home_module_all": st.home_graphs,
    "popularity_indegree_all": st.popularity,
    "labels_first_by_priority_all": lambda q: st.labels(q, [O + "segment", O + "name", O + "title"]).select("iri", "label", F.concat_ws("|", "labels").alias("others")),
    "instance_rollup_all": lambda q: st.instance_rollup(q, q.sparkSession.createDataFrame([(O + a, O + b) for a, b in tg.SUBCLASSES.items()], "below string, above string")),
    "sample_objects_all": st.sample_values,
}


def _whole(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(_quads(spark, d))


QUERIES.update({k: _whole(f) for k, f in WHOLE.items()})

#: Per table its rows (lineitem's key is the row, so equal rows are one node), and per column its predicate and target.
_ROWS = {t: "(SELECT DISTINCT * FROM lineitem)" if t == "lineitem" else t for t in tg.TABLES}
_COLUMNS = [(t, c, *(x.split(" > ") + [None])[:2]) for t, v in tg.TABLES.items() for c, x in (y.split(": ") for y in v[3].split(", "))]
_KEYS = {v[1]: (t, v[2]) for t, v in tg.TABLES.items()}
_ALL = "SELECT {select} FROM (" + " UNION ALL ".join(
    f"SELECT '{G}{tg.TABLES[t][0]}' AS g, '{O}{tg.TABLES[t][1]}' AS class, '{O}{p}' AS p, (SELECT count({c}) FROM {t}) AS n, count({c}) AS users, {bool(to)} AS object FROM {_ROWS[t]}" for t, c, p, to in _COLUMNS
) + ")"
_SIZES = " UNION ALL ".join(f"SELECT '{G}{v[0]}' AS g, '{O}{v[1]}' AS class, count(*) AS instances FROM {_ROWS[t]}" for t, v in tg.TABLES.items())
_POINTED = " UNION ALL ".join(
    [f"SELECT {_id(to, c)} AS iri FROM {t} WHERE {c} IS NOT NULL" for t, c, _, to in _COLUMNS if to] + [f"SELECT '{O}{v[1]}' FROM {t}" for t, v in tg.TABLES.items()]
)
_NAMES = " UNION ALL ".join(
    f"SELECT {_id(tg.TABLES[t][1], tg.TABLES[t][2])} AS iri, {['segment', 'name', 'title'].index(p)} AS rank, {c} AS label FROM {t} WHERE {c} IS NOT NULL" for t, c, p, _ in _COLUMNS if p in ("segment", "name", "title")
)
SQL.update(
    {
        "stats_class_counts_all": _SIZES,
        "stats_predicate_counts_all": _ALL.format(select="g, p, sum(n)::BIGINT AS n, sum(CASE WHEN object THEN 0 ELSE n END)::BIGINT AS literals, sum(CASE WHEN object THEN n ELSE 0 END)::BIGINT AS objects") + " WHERE n > 0 GROUP BY 1, 2",
        "stats_class_predicates_all": _ALL.format(select="g, class, p, users AS instances") + " WHERE users > 0",
        "stats_domains_10pct_all": f"WITH u AS ({_ALL.format(select='class, p, users')}), s AS ({_SIZES}) SELECT p, class, round(users / instances, 6) AS share FROM u JOIN s USING (class) WHERE users >= 0.1 * instances AND users > 0",
        "stats_ranges_all": "WITH n AS (SELECT p, class, sum(n)::BIGINT AS n FROM ("
        + " UNION ALL ".join(f"SELECT '{O}{p}' AS p, '{O}{to}' AS class, count(*) AS n FROM {t} WHERE {c} IN (SELECT {_KEYS[to][1]} FROM {_KEYS[to][0]})" for t, c, p, to in _COLUMNS if to)
        + ") GROUP BY 1, 2) SELECT p, class, n FROM n WHERE n > 0 AND n >= 0.1 * (SELECT max(m.n) FROM n m WHERE m.p = n.p)",
        "home_module_all": "SELECT p, g FROM (SELECT p, g, row_number() OVER (PARTITION BY p ORDER BY n DESC, g) AS k FROM (" + _ALL.format(select="p, g, sum(n) AS n") + " WHERE n > 0 GROUP BY 1, 2)) WHERE k = 1",
        "popularity_indegree_all": f"SELECT iri, count(*) AS popularity FROM ({_POINTED}) GROUP BY iri",
        "labels_first_by_priority_all": f"""WITH n AS ({_NAMES}), b AS (SELECT iri, arg_min(label, (rank, label)) AS label FROM n GROUP BY 1)
          SELECT iri, b.label, coalesce((SELECT string_agg(DISTINCT n.label, '|' ORDER BY n.label) FROM n WHERE n.iri = b.iri AND n.label <> b.label), '') AS others FROM b""",
        "instance_rollup_all": f"WITH s AS ({_SIZES}) SELECT class, instances FROM s UNION ALL SELECT up, sum(instances)::BIGINT FROM s JOIN (VALUES {', '.join(f"('{O}{a}', '{O}{b}')" for a, b in tg.SUBCLASSES.items())}) v(class, up) USING (class) GROUP BY up",
    }
)
