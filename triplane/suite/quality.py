"""Queries on dead links and nested run records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.deliveries import one_delivery
from ..operators.nested import NODE_COLUMNS, contained, element_nodes, entry_nodes, label_columns, label_json, node_table
from ..operators.references import dead_link_counts, dead_links, link_key
from ..runtime import read_table

DEALER = "http://kg.example/onto#Dealer"


def _checked(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Per table its links and the listing periods of what they may point at.

    Links: ``tab, rec_id, ref, period, recorded_at, key``; listing periods: ``key, added_at, removed_at``.
    """
    def links(name: str, rec: str, ref, iri: bool) -> DataFrame:  # noqa: ANN001
        df = read_table(spark, d, name).select(F.lit(name).alias("tab"), F.col(rec).alias("rec_id"), ref.alias("ref"), "recorded_at")
        return df.withColumns({"period": F.date_format("recorded_at", "yyyy-MM"), "key": link_key(F.col("ref"), iri)})

    entity, model = read_table(spark, d, "entity"), read_table(spark, d, "vehicle_model")
    listed = lambda df, col, iri: df.select(link_key(F.col(col), iri).alias("key"), "added_at", "removed_at")
    return {
        "sales_order": (links("sales_order", "order_id", F.col("sold_model_code"), False), listed(model, "model_code", False)),
        "employee": (links("employee", "emp_id", F.col("works_at"), True), listed(entity.where(F.array_contains("types", DEALER)), "iri", True)),
        "benchmark_item": (links("benchmark_item", "row_id", F.explode("gold.entities"), True), listed(entity, "iri", True)),
    }


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    keep = ["tab", "rec_id", "ref", "period"]
    parts = [dead_links(refs, parents, "recorded_at", keep) for refs, parents in _checked(spark, d).values()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("tab", "rec_id", "ref", "kind", "period")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    keep, parts = ["tab", "rec_id", "ref", "period"], []
    for refs, parents in _checked(spark, d).values():
        refs = refs.where("key IS NOT NULL")
        parts.append(dead_link_counts(dead_links(refs, parents, "recorded_at", keep), refs.select(*keep).distinct(), ["tab", "period"]))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _code(x: str) -> str:
    return f"nullif(lower({_trim(x)}), '')"


def _iri(x: str) -> str:
    return _code(f"regexp_replace({_trim(x)}, '^<(.*)>$', '\\1', 's')")


def _links_sql(tab: str, refs: str, norm, parents: str) -> str:  # noqa: ANN001
    same = f"FROM ({parents}) p WHERE {norm('p.v')} = {norm('r.ref')}"
    return f"""SELECT DISTINCT '{tab}' AS tab, r.rec_id, r.ref, strftime(r.recorded_at, '%Y-%m') AS period,
        CASE WHEN EXISTS (SELECT 1 {same} AND p.added_at <= r.recorded_at AND (p.removed_at IS NULL OR r.recorded_at < p.removed_at)) THEN 'live'
          WHEN NOT EXISTS (SELECT 1 {same}) THEN 'missing'
          WHEN (SELECT min(p.added_at) {same}) > r.recorded_at THEN 'late' ELSE 'deleted' END AS kind
        FROM ({refs}) r WHERE {norm('r.ref')} IS NOT NULL"""


_P1_LINKS = " UNION ALL ".join(
    _links_sql(*x)
    for x in (
        ("sales_order", "SELECT order_id AS rec_id, sold_model_code AS ref, recorded_at FROM sales_order", _code, "SELECT model_code AS v, added_at, removed_at FROM vehicle_model"),
        ("employee", "SELECT emp_id AS rec_id, works_at AS ref, recorded_at FROM employee", _iri, f"SELECT iri AS v, added_at, removed_at FROM entity WHERE list_contains(types, '{DEALER}')"),
        ("benchmark_item", "SELECT row_id AS rec_id, unnest(gold.entities) AS ref, recorded_at FROM benchmark_item", _iri, "SELECT iri AS v, added_at, removed_at FROM entity"),
    )
)

#: Fields of a plan that always hold lists; an object found there alone is element 0. Fixed values.
LIST_FIELDS = ("compare", "links", "filters", "edges", "steps", "decisions", "alternatives")


GATE = ("name", "choice", "confidence", "threshold", "passed")
_GATE_TYPE = "struct<name: string, choice: string, confidence: double, threshold: double, passed: boolean>"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """One delivery per run: the first loaded, then the least plan text. Runs without ``run_id`` give no rows."""
    return one_delivery(read_table(spark, d, "eval_run").select("run_id", "stages", "gates", "plan", "loaded_at"), "run_id", ["loaded_at", "plan"])


def column_nodes(runs: DataFrame) -> DataFrame:
    """The nodes of the typed columns: entries of ``stages``, the ``gates`` that are not NULL, their probabilities."""
    return label_columns(runs, "run_id", [entry_nodes("stages", _GATE_TYPE), element_nodes("gates", GATE, "probabilities", _GATE_TYPE)])


def plan_nodes(runs: DataFrame) -> DataFrame:
    """The nodes of the plans, numbered after those of the typed columns, and the root of every run."""
    many = lambda x: F.coalesce(F.greatest(F.size(x), F.lit(0)), F.lit(0))
    gates = F.aggregate("gates", F.lit(0), lambda n, g: n + F.when(g.isNull(), 0).otherwise(1 + many(g["probabilities"])))
    return label_json(runs, "run_id", "plan", "plan", LIST_FIELDS, many(F.col("stages")) + F.coalesce(gates, F.lit(0)))


def run_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The node table of ``eval_run``: every node of every run with its labels and value."""
    runs = _runs(spark, d)
    return column_nodes(runs).drop("number", "item").unionByName(plan_nodes(runs))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return run_nodes(spark, d).where("kind NOT IN ('', 'plan')").select("run_id", "path")


def p3_stages(spark: SparkSession, d: str) -> DataFrame:
    return column_nodes(_runs(spark, d)).where("kind = 'stages'").select("run_id", F.col("name").alias("stage"), F.col("number").alias("ms"))


def p3_gates(spark: SparkSession, d: str) -> DataFrame:
    t = column_nodes(_runs(spark, d)).where("kind = 'gates'")
    return t.select("run_id", F.col("pos").alias("gate"), "item.*", "parent_pre", "pre", "post")


def p3_gate_probabilities(spark: SparkSession, d: str) -> DataFrame:
    t = column_nodes(_runs(spark, d)).where("kind = 'gates.probabilities'")
    return t.select("run_id", "parent_pre", F.col("name").alias("option"), F.col("number").alias("p"), "pre", "post")


def p3_stage_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The stages with their labels: all columns of a node table, and the stage's milliseconds."""
    nodes = column_nodes(_runs(spark, d)).where("kind = 'stages'")
    return nodes.select("run_id", *NODE_COLUMNS[1:], F.col("name").alias("stage"), F.col("number").alias("ms"))


#: Kinds of objects in a plan by the field that holds them: what their columns' names begin with, and their scalar
#: fields. Fixed values.
PLAN_TABLES = {
    "subject": ("subject", ("iri", "label", "types")),
    "answer_path": ("answer_path", ("score",)),
    "links": ("link", ("anchor",)),
    "anchor": ("anchor", ("iri", "label", "types")),
    "path": ("path", ("score",)),
    "edges": ("edge", ("kind", "target")),
    "steps": ("step", ("prop", "inverse", "module")),
    "target": ("target", ("class",)),
    "filters": ("filter", ("op",)),
    "literal": ("literal", ("kind", "value")),
    "range": ("range", ("low", "high")),
    "compare": ("compare", ("iri", "label", "types")),
    "decisions": ("decision", ("name", "choice", "alternatives")),
    "alternatives": ("alternative", ("option", "p")),
}
PLAN_FIELDS = ("shape", "module", "target_class", "limit", "subject", "links", "filters", "notes")


def _plan_table(spark: SparkSession, d: str, kinds: Column, begin: str, fields: tuple[str, ...]) -> DataFrame:
    """A node table with the scalar fields as text, lists as JSON; ``value`` has every field, those not named here too."""
    t = node_table(plan_nodes(_runs(spark, d)), "run_id", kinds)
    return t.withColumns({f"{begin}_{f}": F.get_json_object("value", f"$.{f}") for f in fields})


def p3_plan(spark: SparkSession, d: str) -> DataFrame:
    """The plans themselves, one row per run with a plan."""
    return _plan_table(spark, d, F.col("kind") == "plan", "plan", PLAN_FIELDS)


def _plan_objects(field: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _plan_table(spark, d, F.col("kind").startswith("plan.") & (F.col("name") == field), *PLAN_TABLES[field])

    query.__name__ = f"p3_plan_{field}"
    return query


def p3_plan_others(spark: SparkSession, d: str) -> DataFrame:
    """Objects of a plan in fields that no other table names, so that the tables together have every object once."""
    return node_table(plan_nodes(_runs(spark, d)), "run_id", F.col("kind").startswith("plan.") & ~F.col("name").isin(*PLAN_TABLES))


def p3_steps_in_links(spark: SparkSession, d: str) -> DataFrame:
    """Every step anywhere below a link of the plan, with the link: a sweep by interval containment."""
    nodes = plan_nodes(_runs(spark, d))
    return contained(nodes.where("kind = 'plan.links'"), nodes.where("kind = 'plan.steps'"), "run_id")


_ONCE = "once AS (SELECT run_id, arg_min(struct_pack(stages := stages, gates := gates, plan := plan), (loaded_at, plan)) AS r FROM eval_run WHERE run_id IS NOT NULL GROUP BY 1)"
_LONE = f"'\\.({'|'.join(LIST_FIELDS)})\\.', '.\\1[0].', 'g'"
_P3 = f"""WITH {_ONCE},
  g AS (SELECT run_id, i - 1 AS i, r.gates[i] AS g FROM (SELECT run_id, r, unnest(range(1, len(r.gates) + 1)) AS i FROM once) WHERE r.gates[i] IS NOT NULL),
  j AS (SELECT run_id, CASE WHEN NOT json_valid(r.plan) THEN NULL WHEN json_type(r.plan) = 'VARCHAR' THEN json_extract_string(r.plan, '$') ELSE r.plan END AS p FROM once WHERE r.plan IS NOT NULL),
  t AS (SELECT j.run_id, t.fullkey AS k FROM (SELECT * FROM j WHERE p IS NOT NULL AND json_valid(p)) j, json_tree(j.p) t WHERE t.type = 'OBJECT' AND t.fullkey <> '$')
SELECT run_id, 'stages[' || k || ']' AS path FROM (SELECT run_id, unnest(map_keys(r.stages)) AS k FROM once)
UNION ALL SELECT run_id, 'gates[' || i || ']' FROM g
UNION ALL SELECT run_id, 'gates[' || i || '].probabilities[' || k || ']' FROM (SELECT run_id, i, unnest(map_keys(g.probabilities)) AS k FROM g)
UNION ALL SELECT run_id, 'plan' || rtrim(regexp_replace(regexp_replace(substr(k, 2) || '.', {_LONE}), {_LONE}), '.') FROM t"""

#: The typed columns with their labels: entries and elements in order, and how many nodes come before each.
_TYPED = """s AS (SELECT run_id, e, row_number() OVER (PARTITION BY run_id ORDER BY e.key) AS nth FROM (SELECT run_id, unnest(map_entries(r.stages)) AS e FROM once)),
  g0 AS (SELECT run_id, r, unnest(range(1, len(r.gates) + 1)) AS i FROM once),
  g1 AS (SELECT run_id, i - 1 AS gate, r.gates[i] AS g, coalesce(len(map_keys(r.stages)), 0) AS stages, coalesce(len(map_keys(r.gates[i].probabilities)), 0) AS below FROM g0 WHERE r.gates[i] IS NOT NULL),
  g2 AS (SELECT *, (1 + stages + coalesce(sum(1 + below) OVER (PARTITION BY run_id ORDER BY gate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS pre FROM g1),
  typed AS (SELECT run_id, coalesce(len(map_keys(r.stages)), 0) + coalesce(n, 0) AS n FROM once LEFT JOIN (SELECT run_id, sum(1 + below) AS n FROM g1 GROUP BY 1) USING (run_id))"""
_SEGMENT = '\\.("[^"]*"|[^.\\[]+)'
#: Every object of a plan that is one, by DuckDB's own walk; its value is itself without the fields that hold objects.
_PLANS = f"""WITH {_ONCE}, {_TYPED},
  j AS (SELECT run_id, CASE WHEN NOT json_valid(r.plan) THEN NULL WHEN json_type(r.plan) = 'VARCHAR' THEN json_extract_string(r.plan, '$') ELSE r.plan END AS p FROM once WHERE r.plan IS NOT NULL),
  o0 AS (SELECT j.run_id, t.id, t.value AS v, t.fullkey AS k FROM (SELECT * FROM j WHERE p IS NOT NULL AND json_valid(p)) j, json_tree(j.p) t WHERE t.type = 'OBJECT'),
  o1 AS (SELECT *, regexp_replace(k, '{_SEGMENT}(\\[[0-9]+\\])*$', '') AS up, len(regexp_extract_all(k, '{_SEGMENT}')) + 1 AS depth, regexp_extract(k, '{_SEGMENT}(\\[[0-9]+\\])*$', 1) AS name,
    regexp_extract(k, '\\[([0-9]+)\\]$', 1) AS el, row_number() OVER (PARTITION BY run_id ORDER BY id) + typed.n AS pre FROM o0 JOIN typed USING (run_id)),
  o2 AS (SELECT a.run_id, a.k, a.up, a.depth, a.name, a.el, a.pre, a.v, count(b.k) AS below, string_agg(DISTINCT '"' || b.name || '":null', ',') FILTER (b.up = a.k) AS inner_fields
    FROM o1 a LEFT JOIN o1 b ON a.run_id = b.run_id AND starts_with(b.k, a.k || '.') GROUP BY ALL),
  o AS (SELECT o2.run_id, 'plan' || rtrim(regexp_replace(regexp_replace(substr(o2.k, 2) || '.', {_LONE}), {_LONE}), '.') AS path, o2.pre::INTEGER AS pre, (o2.pre + o2.below - o2.depth)::INTEGER AS post, o2.depth::INTEGER AS depth,
    coalesce(p.pre, 0)::INTEGER AS parent_pre, CASE WHEN o2.el <> '' THEN o2.el::INTEGER WHEN o2.name IN {LIST_FIELDS} THEN 0 END AS pos, nullif(o2.name, '') AS name,
    json_merge_patch(o2.v, '{{' || coalesce(o2.inner_fields, '') || '}}')::VARCHAR AS value FROM o2 LEFT JOIN o1 p ON p.run_id = o2.run_id AND p.k = o2.up AND o2.name <> '')"""


def _plan_sql(where: str, begin: str = "", fields: tuple[str, ...] = ()) -> str:
    columns = "".join(f", json_extract_string(value, '$.{f}') AS {begin}_{f}" for f in fields)
    return f"{_PLANS} SELECT run_id, path, pre, post, depth, parent_pre, pos, name, value{columns} FROM o WHERE {where}"


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p3_found": p3_found,
    "p3_stages": p3_stages,
    "p3_gates": p3_gates,
    "p3_gate_probabilities": p3_gate_probabilities,
    "p3_stage_nodes": p3_stage_nodes,
    "p3_plan": p3_plan,
    **{f"p3_plan_{f}": _plan_objects(f) for f in PLAN_TABLES},
    "p3_plan_others": p3_plan_others,
    "p3_steps_in_links": p3_steps_in_links,
}
SQL = {
    "p3_found": _P3,
    "p3_stages": f"WITH {_ONCE}, s AS (SELECT run_id, unnest(map_entries(r.stages)) AS e FROM once) SELECT run_id, e.key AS stage, e.value AS ms FROM s",
    "p3_stage_nodes": f"""WITH {_ONCE}, {_TYPED} SELECT run_id, 'stages[' || e.key || ']' AS path, nth::INTEGER AS pre, (nth - 1)::INTEGER AS post, 1 AS depth, 0 AS parent_pre, NULL::INTEGER AS pos,
      e.key AS name, e.value::VARCHAR AS value, e.key AS stage, e.value AS ms FROM s""",
    "p3_gates": f"""WITH {_ONCE}, {_TYPED} SELECT run_id, gate::INTEGER AS gate, g.name, g.choice, g.confidence, g.threshold, g.passed, 0 AS parent_pre, pre, (pre + below - 1)::INTEGER AS post FROM g2""",
    "p3_gate_probabilities": f"""WITH {_ONCE}, {_TYPED}, x AS (SELECT run_id, pre AS parent_pre, unnest(map_entries(g.probabilities)) AS e FROM g2),
      y AS (SELECT *, row_number() OVER (PARTITION BY run_id, parent_pre ORDER BY e.key) AS nth FROM x)
      SELECT run_id, parent_pre, e.key AS option, e.value AS p, (parent_pre + nth)::INTEGER AS pre, (parent_pre + nth - 2)::INTEGER AS post FROM y""",
    "p3_plan": _plan_sql("name IS NULL", "plan", PLAN_FIELDS),
    **{f"p3_plan_{f}": _plan_sql(f"name = '{f}'", *PLAN_TABLES[f]) for f in PLAN_TABLES},
    "p3_plan_others": _plan_sql(f"name NOT IN {tuple(PLAN_TABLES)}"),
    "p3_steps_in_links": f"""{_P3.replace("SELECT run_id, 'stages[' || k", ", f AS (SELECT run_id, 'stages[' || k", 1)}), 
      l AS (SELECT run_id, path FROM f WHERE regexp_matches(path, '^plan\\.links\\[[0-9]+\\]$')), st AS (SELECT run_id, path FROM f WHERE regexp_matches(path, '\\.steps\\[[0-9]+\\]$'))
      SELECT l.run_id, l.path AS outer_path, st.path AS inner_path FROM l JOIN st ON l.run_id = st.run_id AND starts_with(st.path, l.path || '.')""",
    "p1_found": f"SELECT tab, rec_id, ref, kind, period FROM ({_P1_LINKS}) WHERE kind <> 'live'",
    "p1_report": f"""SELECT tab, period, count(*) AS links, count(*) FILTER (kind = 'missing') AS missing,
        count(*) FILTER (kind = 'late') AS late, count(*) FILTER (kind = 'deleted') AS deleted FROM ({_P1_LINKS}) GROUP BY tab, period""",
}
