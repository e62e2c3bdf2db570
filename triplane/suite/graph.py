"""Plans and SPARQL texts over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.algebra import Compiler
from ..plans.plan import Filter, Link, Literal, PlanCompiler, QueryPlan, Step, year
from ..runtime import read_table
from ..sources import testgraph as tg
from ..sources.quads import to_lines
from ..sources.store import QuadStore

O = tg.ONTO  # noqa: E741
G = tg.GRAPH
NATION3 = tg.node("Nation", 3)


def _step(name: str, graph: str | None = None, inverse: bool = False) -> Step:
    return Step(O + name, inverse, G + graph if graph else None)


PLACED, LOCATED, TOTAL, ORDERED = _step("placedBy", "sales"), _step("locatedIn", "party"), _step("total", "sales"), _step("date", "sales")
ORDERS = {"classes": tg.below("Order"), "graph": G + "sales"}
IN_NATION = Link((PLACED, LOCATED), NATION3)
IN_1995 = Filter((ORDERED,), "eq", year(1995), temporal=True)


def _plan(tables: tuple[str, ...], plan: QueryPlan, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return shape(PlanCompiler(tg.store(spark, d, *tables)).compile(plan).df)

    return run


def _text(tables: tuple[str, ...], query: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return shape(Compiler(tg.store(spark, d, *tables), tg.PREFIXES, merged=False).select(query))

    return run


def _rounded(*names: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({n: F.round(F.col(n).cast("double"), 2) for n in names})


SALES = ("orders", "customer")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _id(cls: str, key: str) -> str:
    return f"'{tg.ID}{cls.lower()}/' || {key}"


# ---- lookups and paths
_add(
    "lookup_attribute",
    _plan(("customer",), QueryPlan("lookup", subject=tg.node("Customer", 7), path=(_step("acctbal", "party"),))),
    "SELECT DISTINCT c_acctbal AS answer FROM customer WHERE c_custkey = 7",
)
_add(
    "path_two_hop",
    _plan(("customer", "nation"), QueryPlan("path", subject=tg.node("Customer", 7), path=(LOCATED, _step("name", "geo")))),
    "SELECT DISTINCT n_name AS answer FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7",
)
_add(
    "path_cross_module",
    _plan(("orders", "customer", "nation", "region"), QueryPlan("path", subject=tg.node("Order", 32), path=(PLACED, LOCATED, _step("inRegion", "geo"), _step("name", "geo")))),
    "SELECT DISTINCT r_name AS answer FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderkey = 32",
)
_add(
    "path_inverse",
    _plan(SALES, QueryPlan("path", subject=NATION3, path=(_step("locatedIn", "party", True), _step("placedBy", "sales", True), _step("total", "sales")))),
    "SELECT DISTINCT o_totalprice AS answer FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3",
)
# ---- counts and lists
_add(
    "count_distinct_target",
    _plan(SALES, QueryPlan("count", **ORDERS, links=(IN_NATION,), filters=(IN_1995,))),
    "SELECT count(DISTINCT o_orderkey) AS answer FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 AND year(o_orderdate) = 1995",
)
_add(
    "count_zero_is_answer",
    _plan(SALES, QueryPlan("count", **ORDERS, links=(IN_NATION,), filters=(Filter((TOTAL,), "gt", Literal("number", 1e12)),))),
    "SELECT count(*) AS answer FROM orders WHERE o_totalprice > 1e12",
)
_add(
    "count_subclass_closure",
    _plan(("customer", "supplier"), QueryPlan("count", classes=tg.below("Party"), graph=G + "party", filters=(Filter((_step("acctbal", "party"),), "gt", Literal("number", 5000)),))),
    "SELECT (SELECT count(*) FROM customer WHERE c_acctbal > 5000) + (SELECT count(*) FROM supplier WHERE s_acctbal > 5000) AS answer",
)
_add(
    "relaxed_count",
    lambda spark, d: PlanCompiler(tg.store(spark, d, *SALES)).relaxed_count(QueryPlan("aggregate", **ORDERS, links=(IN_NATION,), filters=(IN_1995,), path=(TOTAL,), agg="sum")),
    "SELECT count(*) AS answer FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3",
)
_add(
    "list_filtered_conjunction",
    _plan(SALES, QueryPlan("list", **ORDERS, links=(IN_NATION,), filters=(IN_1995, Filter((TOTAL,), "ge", Literal("number", 200000)), Filter((_step("status", "sales"),), "eq", Literal("string", "F"))))),
    f"SELECT {_id('Order', 'o_orderkey')} AS answer FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 AND year(o_orderdate) = 1995 AND o_totalprice >= 200000 AND o_orderstatus = 'F'",
)
_add(
    "filter_string_value",
    _plan(("customer",), QueryPlan("count", classes=tg.below("Customer"), graph=G + "party", filters=(Filter((_step("segment", "party"),), "eq", Literal("string", "BUILDING")),))),
    "SELECT count(*) AS answer FROM customer WHERE c_mktsegment = 'BUILDING'",
)
for _op, _sql in {"eq": ">= '1997-01-01' AND o_orderdate < '1998-01-01'", "gt": ">= '1998-01-01'", "ge": ">= '1997-01-01'", "lt": "< '1997-01-01'", "le": "< '1998-01-01'"}.items():
    _add(
        f"filter_period_{_op}",
        _plan(("orders",), QueryPlan("count", **ORDERS, filters=(Filter((ORDERED,), _op, year(1997), temporal=True),))),
        f"SELECT count(*) AS answer FROM orders WHERE o_orderdate {_sql}",
    )
# ---- aggregates
for _agg in ("sum", "avg", "min", "max"):
    _add(
        f"aggregate_{_agg}",
        _plan(SALES, QueryPlan("aggregate", **ORDERS, links=(IN_NATION,), filters=(IN_1995,), path=(TOTAL,), agg=_agg), _rounded("answer")),
        f"SELECT round({_agg}(m), 2) AS answer, count(m) AS n FROM (SELECT DISTINCT o_orderkey, o_totalprice AS m FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 AND year(o_orderdate) = 1995)",
    )
_add(
    "aggregate_empty_guard",
    _plan(SALES, QueryPlan("aggregate", **ORDERS, links=(IN_NATION,), filters=(Filter((ORDERED,), "eq", year(1901), temporal=True),), path=(TOTAL,), agg="sum"), _rounded("answer")),
    "SELECT CAST(NULL AS DOUBLE) AS answer, 0 AS n",
)
# ---- extremes
for _order, _fn in {"desc": "max", "asc": "min"}.items():
    _add(
        f"superlative_{_order}_ties",
        _plan(("part",), QueryPlan("superlative", classes=tg.below("Part"), graph=G + "catalog", path=(_step("size", "catalog"),), order=_order)),
        f"SELECT {_id('Part', 'p_partkey')} AS answer, p_size AS measure FROM part WHERE p_size = (SELECT {_fn}(p_size) FROM part)",
    )
    _add(
        f"compare_{_fn}",
        _plan(SALES, QueryPlan("compare", compare=tuple(tg.node("Customer", k) for k in (1, 2, 4, 5, 7)), path=(_step("placedBy", "sales", True), TOTAL), order=_order)),
        f"""WITH b AS (SELECT o_custkey, {_fn}(o_totalprice) AS m FROM orders WHERE o_custkey IN (1, 2, 4, 5, 7) GROUP BY 1)
        SELECT {_id('Customer', 'o_custkey')} AS answer, m AS measure FROM b WHERE m = (SELECT {_fn}(m) FROM b)""",
    )
# ---- yes or no
for _name, _low in {"true": 0, "false": 10**12}.items():
    _add(
        f"boolean_{_name}",
        _plan(SALES, QueryPlan("boolean", subject=NATION3, filters=(Filter((_step("locatedIn", "party", True), _step("placedBy", "sales", True), TOTAL), "gt", Literal("number", _low)),))),
        f"SELECT count(*) > 0 AS answer FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 AND o_totalprice > {_low}",
    )

# ---- SPARQL texts
_add(
    "shared_identifier_join",
    _text(("lineitem", "part"), "SELECT ?brand (SUM(?q) AS ?qty) (COUNT(*) AS ?lines) WHERE { GRAPH g:sales { ?l t:forPartCode ?code ; t:quantity ?q } GRAPH g:catalog { ?p t:partCode ?code ; t:brand ?brand } } GROUP BY ?brand"),
    "SELECT p_brand AS brand, sum(l_quantity) AS qty, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
_add(
    "join_overlap",
    _text(("lineitem", "part"), "SELECT (COUNT(DISTINCT ?code) AS ?shared) WHERE { GRAPH g:sales { ?l t:forPartCode ?code } GRAPH g:catalog { ?p t:partCode ?code } }"),
    "SELECT count(DISTINCT l_partkey) AS shared FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)",
)
_add(
    "optional_left",
    _text(SALES, "SELECT ?c (COUNT(?o) AS ?orders) WHERE { ?c a t:Customer OPTIONAL { ?o t:placedBy ?c ; t:total ?m FILTER(?m > 250000) } } GROUP BY ?c"),
    f"SELECT {_id('Customer', 'c_custkey')} AS c, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000 GROUP BY c_custkey",
)
_add(
    "values_join",
    _text(("nation", "region"), "SELECT ?name ?region WHERE { VALUES ?region { 'ASIA' 'EUROPE' } ?n t:inRegion ?r ; t:name ?name . ?r t:name ?region }"),
    "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')",
)
_add(
    "union_graphs",
    _text(("customer", "supplier", "nation"), "SELECT ?n (COUNT(*) AS ?k) WHERE { { ?x a t:Customer ; t:locatedIn ?n } UNION { ?x a t:Supplier ; t:locatedIn ?n } } GROUP BY ?n"),
    f"SELECT {_id('Nation', 'k')} AS n, count(*) AS k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k",
)


def union_default_graph(spark: SparkSession, d: str) -> DataFrame:
    """Two graphs with the same statements read as one: each counts once."""
    quads = tg.store(spark, d, "nation", "region").quads()
    twice = quads.unionByName(quads.withColumn("g", F.lit(G + "copy")))
    return Compiler(QuadStore(twice), tg.PREFIXES).select("SELECT ?r (COUNT(*) AS ?k) WHERE { ?n t:inRegion ?r } GROUP BY ?r")


_add("union_default_graph", union_default_graph, f"SELECT {_id('Region', 'n_regionkey')} AS r, count(*) AS k FROM nation GROUP BY n_regionkey")
_add(
    "minus_antijoin",
    _text(SALES, "SELECT ?c WHERE { ?c a t:Customer MINUS { ?o t:placedBy ?c ; t:priority '1-URGENT' ; t:status 'F' } }"),
    f"SELECT {_id('Customer', 'c_custkey')} AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')",
)
_add(
    "exists_semijoin",
    _text(SALES, "SELECT ?c WHERE { ?c a t:Customer FILTER EXISTS { ?o t:placedBy ?c ; t:priority '1-URGENT' } }"),
    f"SELECT {_id('Customer', 'c_custkey')} AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
)
_add(
    "not_exists_antijoin",
    _text(SALES, "SELECT (COUNT(*) AS ?n) WHERE { ?c a t:Customer FILTER NOT EXISTS { ?o t:placedBy ?c ; t:priority '1-URGENT' } }"),
    "SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
)


def construct_triples(spark: SparkSession, d: str) -> DataFrame:
    got = Compiler(tg.store(spark, d, "nation", "region"), tg.PREFIXES, merged=False).construct("CONSTRUCT { ?r t:hasNation ?n . ?r t:label ?name } WHERE { ?n t:inRegion ?r . ?r t:name ?name }")
    return to_lines(got.withColumn("g", F.lit(None).cast("string")))


_add(
    "construct_triples",
    construct_triples,
    f"""SELECT '<' || {_id('Region', 'n_regionkey')} || '> <{O}hasNation> <' || {_id('Nation', 'n_nationkey')} || '> .' AS value FROM nation
    UNION SELECT '<' || {_id('Region', 'r_regionkey')} || '> <{O}label> "' || r_name || '" .' FROM region""",
)
_add(
    "groupby_breakdown",
    _text(("orders", "customer", "nation"), "SELECT ?nation ?priority (SUM(?m) AS ?total) (COUNT(*) AS ?n) WHERE { ?o t:placedBy ?c ; t:total ?m ; t:priority ?priority . ?c a t:Customer ; t:locatedIn ?x . ?x t:name ?nation } GROUP BY ?nation ?priority", _rounded("total")),
    "SELECT n_name AS nation, o_orderpriority AS priority, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
)
_add(
    "having_filter",
    _text(("orders",), "SELECT ?c (COUNT(*) AS ?n) WHERE { ?o t:placedBy ?c } GROUP BY ?c HAVING (COUNT(*) > 15)"),
    f"SELECT {_id('Customer', 'o_custkey')} AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
)
_add(
    "subselect_distinct",
    _text(SALES, "SELECT (AVG(?k) AS ?mean) WHERE { SELECT ?c (COUNT(DISTINCT ?p) AS ?k) WHERE { ?o t:placedBy ?c ; t:priority ?p } GROUP BY ?c }", _rounded("mean")),
    "SELECT round(avg(k), 2) AS mean FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY 1)",
)
_add(
    "order_limit_offset",
    _text(("orders",), "SELECT ?o ?m WHERE { ?o t:total ?m } ORDER BY DESC(?m) ?o LIMIT 20 OFFSET 10"),
    f"SELECT {_id('Order', 'o_orderkey')} AS o, o_totalprice AS m FROM orders ORDER BY m DESC, o LIMIT 20 OFFSET 10",
)
_add(
    "bind_if_arithmetic",
    _text(("lineitem",), "SELECT ?band (SUM(?net) AS ?total) WHERE { ?l t:extended ?e ; t:discount ?x ; t:quantity ?q BIND(?e * (1 - ?x) AS ?net) BIND(IF(?q >= 25, 'large', 'small') AS ?band) } GROUP BY ?band", _rounded("total")),
    "SELECT CASE WHEN l_quantity >= 25 THEN 'large' ELSE 'small' END AS band, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem GROUP BY 1",
)
_add(
    "date_and_string_functions",
    _text(("orders",), "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o t:date ?d ; t:priority ?p FILTER(CONTAINS(LCASE(?p), 'high') || STRSTARTS(?p, '1')) BIND(YEAR(?d) AS ?y) } GROUP BY ?y"),
    "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE contains(lower(o_orderpriority), 'high') OR starts_with(o_orderpriority, '1') GROUP BY 1",
)
_add(
    "regex_filter",
    _text(("part",), "SELECT ?p ?b WHERE { ?p t:brand ?b FILTER(REGEX(?b, '^brand#1[1-3]$', 'i')) }"),
    f"SELECT {_id('Part', 'p_partkey')} AS p, p_brand AS b FROM part WHERE regexp_matches(p_brand, '^brand#1[1-3]$', 'i')",
)
_add(
    "in_list_filter",
    _text(("customer",), "SELECT ?s (COUNT(*) AS ?n) WHERE { ?c t:segment ?s FILTER(?s IN ('BUILDING', 'MACHINERY')) } GROUP BY ?s"),
    "SELECT c_mktsegment AS s, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1",
)
_add(
    "path_sequence_inverse_text",
    _text(SALES, f"SELECT ?p (COUNT(*) AS ?n) WHERE {{ <{NATION3}> ^t:locatedIn/^t:placedBy ?o . ?o t:priority ?p }} GROUP BY ?p"),
    "SELECT o_orderpriority AS p, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 GROUP BY 1",
)
_add(
    "path_alternative_text",
    _text(("nation", "region"), "SELECT (COUNT(*) AS ?n) WHERE { ?x t:inRegion|t:name ?v }"),
    "SELECT (SELECT count(*) FROM nation) * 2 + (SELECT count(*) FROM region) AS n",
)
_add(
    "path_closure_text",
    _text(("nation", "region", "customer"), "SELECT ?r (COUNT(DISTINCT ?c) AS ?n) WHERE { ?c a t:Customer . ?c (t:locatedIn|t:inRegion)+ ?r . ?r a t:Region } GROUP BY ?r"),
    f"SELECT {_id('Region', 'n_regionkey')} AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey",
)
_add(
    "graph_variable",
    _text((), "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?x a ?c } } GROUP BY ?g"),
    " UNION ALL ".join(f"SELECT '{G}{g}' AS g, {' + '.join(f'(SELECT count(*) FROM {t})' for t, (h, *_) in tg.TABLES.items() if h == g)} AS n" for g in dict.fromkeys(v[0] for v in tg.TABLES.values())),
)
_add(
    "group_concat",
    _text(("nation", "region"), "SELECT ?region (GROUP_CONCAT(DISTINCT ?name; SEPARATOR='|') AS ?names) WHERE { ?n t:inRegion ?r ; t:name ?name . ?r t:name ?region } GROUP BY ?region"),
    "SELECT r_name AS region, string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1",
)
_add(
    "quads_equal_virtual",
    lambda spark, d: Compiler(QuadStore(tg.store(spark, d, "orders", "customer").quads()), tg.PREFIXES).select("SELECT ?c (COUNT(*) AS ?n) (SUM(?m) AS ?total) WHERE { ?o t:placedBy ?c ; t:total ?m . ?c t:segment 'BUILDING' FILTER(?m >= 100000) } GROUP BY ?c").withColumn("total", F.round("total", 2)),
    f"SELECT {_id('Customer', 'c_custkey')} AS c, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice >= 100000 GROUP BY c_custkey",
)


# ---- joins after OPTIONAL, variables that may be unbound, paths from a bound end
_add(
    "optional_then_join",
    _text(("orders", "customer", "nation"), "SELECT ?o ?x WHERE { ?c a t:Customer OPTIONAL { ?c t:locatedIn ?n } ?o t:placedBy ?c . ?n t:name ?x }"),
    f"SELECT {_id('Order', 'o_orderkey')} AS o, n_name AS x FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
)
_add(
    "optional_chain",
    _text(SALES, "SELECT ?c (COUNT(?o) AS ?n) (MAX(?m) AS ?top) WHERE { ?c a t:Customer OPTIONAL { ?o t:placedBy ?c ; t:priority '1-URGENT' } OPTIONAL { ?o t:total ?m } } GROUP BY ?c"),
    f"""SELECT {_id('Customer', 'c_custkey')} AS c, coalesce(k, 0) AS n, coalesce(m, (SELECT max(o_totalprice) FROM orders)) AS top FROM customer
      LEFT JOIN (SELECT o_custkey, count(*) AS k, max(o_totalprice) AS m FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey WHERE k IS NOT NULL
    UNION ALL SELECT {_id('Customer', 'c_custkey')}, (SELECT count(*) FROM orders), (SELECT max(o_totalprice) FROM orders) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
_add(
    "minus_unbound",
    _text(SALES, "SELECT (COUNT(*) AS ?n) WHERE { ?c a t:Customer OPTIONAL { ?o t:placedBy ?c ; t:priority '1-URGENT' ; t:status 'F' } MINUS { ?o t:status 'F' } }"),
    "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')",
)
_add(
    "path_star_text",
    _text(("nation", "region"), "SELECT ?x (COUNT(?r) AS ?n) WHERE { ?x a t:Nation . ?x t:inRegion* ?r } GROUP BY ?x"),
    f"SELECT {_id('Nation', 'n_nationkey')} AS x, 2 AS n FROM nation",
)
_add(
    "path_optional_text",
    _text(("customer", "nation"), "SELECT ?x (COUNT(DISTINCT ?c) AS ?n) WHERE { ?c t:segment 'BUILDING' . ?c t:locatedIn? ?x . ?x t:name ?name } GROUP BY ?x"),
    f"SELECT {_id('Customer', 'c_custkey')} AS x, 1 AS n FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT {_id('Nation', 'c_nationkey')}, count(*) FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey",
)
_add(
    "path_from_constant",
    _text(("nation", "region", "customer"), f"SELECT ?x WHERE {{ <{tg.node('Customer', 7)}> (t:locatedIn|t:inRegion)+ ?x }}"),
    f"SELECT {_id('Nation', 'c_nationkey')} AS x FROM customer WHERE c_custkey = 7 UNION ALL SELECT {_id('Region', 'n_regionkey')} FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7",
)
_add(
    "path_to_constant",
    _text(("nation", "region", "customer"), f"SELECT (COUNT(?x) AS ?n) WHERE {{ ?x (t:locatedIn|t:inRegion)+ <{tg.node('Region', 2)}> }}"),
    "SELECT (SELECT count(*) FROM nation WHERE n_regionkey = 2) + (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2) AS n",
)


# ---- yes or no, tests of terms, values that may be missing
def _ask(tables: tuple[str, ...], query: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: spark.createDataFrame([(Compiler(tg.store(spark, d, *tables), tg.PREFIXES, merged=False).ask(query, seconds=600),)], "answer boolean")


for _name, _limit in {"true": 100000, "false": 10**12}.items():
    _add(f"ask_{_name}", _ask(SALES, f"ASK {{ ?o t:placedBy ?c ; t:total ?m . ?c t:segment 'BUILDING' FILTER(?m > {_limit}) }}"), f"SELECT count(*) > 0 AS answer FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > {_limit}")
_XSD = tg.PREFIXES["xsd"]
_add(
    "term_tests",
    _text(("orders", "customer"), "SELECT ?iri ?literal ?type (COUNT(*) AS ?n) WHERE { ?s ?p ?v BIND(isIRI(?v) AS ?iri) BIND(isLiteral(?v) AS ?literal) BIND(COALESCE(DATATYPE(?v), 'none') AS ?type) } GROUP BY ?iri ?literal ?type"),
    f"""SELECT true AS iri, false AS literal, 'none' AS type, (SELECT count(*) + count(o_custkey) FROM orders) + (SELECT count(*) + count(c_nationkey) FROM customer) AS n
    UNION ALL SELECT false, true, '{_XSD}string', (SELECT count(o_orderstatus) + count(o_orderpriority) FROM orders) + (SELECT count(c_name) + count(c_mktsegment) FROM customer)
    UNION ALL SELECT false, true, '{_XSD}double', (SELECT count(o_totalprice) FROM orders) + (SELECT count(c_acctbal) FROM customer)
    UNION ALL SELECT false, true, '{_XSD}dateTime', count(o_orderdate) FROM orders""",
)


def language_tags(spark: SparkSession, d: str) -> DataFrame:
    """Titles as literals with the language their document states, counted by language range."""
    docs = tg.store(spark, d, "documents").quads().where(F.col("p") == O + "title")
    lang = read_table(spark, d, "documents").select(F.concat(F.lit(f"{tg.ID}document/"), F.col("doc_id").cast("string")).alias("s"), F.lower("lang").alias("lang"))
    tagged = docs.join(lang, "s", "left").withColumns({"o_lang": F.when(F.col("lang").rlike("^[a-z]+(-[a-z0-9]+)*$"), F.col("lang")), "o_dt": F.when(F.col("lang").rlike("^[a-z]+(-[a-z0-9]+)*$"), F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")).otherwise(F.col("o_dt"))}).drop("lang")
    return Compiler(QuadStore(tagged), tg.PREFIXES).select("SELECT ?tag (COUNT(*) AS ?n) WHERE { ?d t:title ?v FILTER(langMatches(LANG(?v), '*')) BIND(LANG(?v) AS ?tag) } GROUP BY ?tag")


_add("language_tags", language_tags, "SELECT lower(lang) AS tag, count(*) AS n FROM documents WHERE title IS NOT NULL AND regexp_matches(lower(lang), '^[a-z]+(-[a-z0-9]+)*$') GROUP BY 1")
_add(
    "coalesce_sample",
    _text(("nation", "region"), "SELECT ?region (SAMPLE(?region) AS ?some) (COALESCE(MAX(?n), 'none') AS ?last) WHERE { ?r a t:Region ; t:name ?region OPTIONAL { ?x t:inRegion ?r ; t:name ?n FILTER(STRSTARTS(?n, 'NATION_1')) } } GROUP BY ?region"),
    "SELECT r_name AS region, r_name AS some, coalesce(max(n_name), 'none') AS last FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND starts_with(n_name, 'NATION_1') GROUP BY r_name",
)
_add(
    "values_undef",
    _text(("nation", "region"), "SELECT ?name ?region WHERE { VALUES (?name ?region) { ('NATION_3' UNDEF) (UNDEF 'ASIA') ('NATION_5' 'AFRICA') ('NATION_5' 'ASIA') } ?n t:inRegion ?r ; t:name ?name . ?r t:name ?region }"),
    "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_3' OR r_name = 'ASIA' OR (n_name = 'NATION_5' AND r_name = 'AFRICA')",
)
