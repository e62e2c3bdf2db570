"""The named queries of the training-data operators over the test tables."""

from __future__ import annotations


import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.deliveries import one_delivery
from ..runtime import materialize, read_table
from . import canonical, formatcopies, mixing, packing, quantiles, sharedspans, tokens, toplist
from .sparqlform import record_form

# ---------------------------------------------------------------- 2: best candidates of every mention
TOP = 8


def _entries(spark: SparkSession, d: str) -> DataFrame:
    listed = read_table(spark, d, "candidate").select("mention_id", "iri", "score")
    inline = read_table(spark, d, "mention").select("mention_id", F.explode("candidates").alias("c")).select("mention_id", "c.iri", "c.score")
    return listed.unionByName(inline)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return toplist.top_per_group(_entries(spark, d), "mention_id", "iri", "score", TOP).select("mention_id", "rank", "iri")


P2_SQL = f"""WITH e AS (SELECT mention_id, iri, score FROM candidate
    UNION ALL SELECT mention_id, c.iri, c.score FROM (SELECT mention_id, unnest(candidates) AS c FROM mention)),
  b AS (SELECT mention_id, iri, max(score) AS s FROM e WHERE mention_id IS NOT NULL AND iri IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2)
SELECT mention_id, rank, iri FROM (SELECT mention_id, row_number() OVER (PARTITION BY mention_id ORDER BY s DESC, iri) AS rank, iri FROM b) WHERE rank <= {TOP}"""

# ---------------------------------------------------------------- 4: percentiles of run times
ERROR = 0.01
POINTS = [50, 90, 95, 99]


def _stored_times(spark: SparkSession, d: str) -> DataFrame:
    """``day, arm, metric, ms``: the latency and each stage of every run as stored, each run once, the first loaded."""
    once = one_delivery(read_table(spark, d, "eval_run").select("run_id", "arm", "latency_ms", "stages", "started_at", "loaded_at"), "run_id", ["loaded_at"])
    entries = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("latency_ms").alias("value"))), F.coalesce(F.map_entries("stages"), F.array().cast("array<struct<key:string,value:double>>")))
    t = once.select(F.to_date("started_at").alias("day"), "arm", F.explode(entries).alias("e"))
    return t.select("day", "arm", F.coalesce(F.concat(F.lit("stages/"), F.col("e.key")), F.lit("latency_ms")).alias("metric"), F.col("e.value").alias("ms"))


def _times(spark: SparkSession, d: str) -> DataFrame:
    """Negative times are impossible and don't count."""
    return _stored_times(spark, d).where("ms >= 0")


def p4_day_sketch(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.sketch(_times(spark, d), ["day", "arm", "metric"], "ms", ERROR)


def _read(sketches: DataFrame, by: list[str]) -> DataFrame:
    got = quantiles.percentiles(sketches, by, POINTS, ERROR)
    return got.select(*by, "n", *[F.round(f"p{q}", 6).alias(f"p{q}") for q in POINTS])


def p4_percentiles_by_day(spark: SparkSession, d: str) -> DataFrame:
    return _read(p4_day_sketch(spark, d), ["day", "arm", "metric"])


def p4_percentiles_by_month(spark: SparkSession, d: str) -> DataFrame:
    by = ["month", "arm", "metric"]
    days = p4_day_sketch(spark, d).withColumn("month", F.date_format("day", "yyyy-MM"))
    return _read(quantiles.merge(days, by), by)


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """All days put together."""
    by = ["arm", "metric"]
    return _read(quantiles.merge(p4_day_sketch(spark, d), by), by)


def p4_percentiles_stored(spark: SparkSession, d: str) -> DataFrame:
    """Of every finite value as stored, the impossible negative ones too."""
    by = ["arm", "metric"]
    return _read(quantiles.sketch(_stored_times(spark, d), by, "ms", ERROR), by)


_GAMMA = (1 + ERROR) / (1 - ERROR)
#: Makes the least double's bucket 1 or more.
_OFFSET = 2 - math.floor(math.log(5e-324) / math.log(_GAMMA))
_P4_SKETCH = f"""WITH once AS (SELECT run_id, arg_min(struct_pack(arm := arm, latency_ms := latency_ms, stages := stages, started_at := started_at), loaded_at) AS r
    FROM eval_run WHERE run_id IS NOT NULL GROUP BY run_id),
  t AS (SELECT r.started_at::DATE AS day, r.arm AS arm, 'latency_ms' AS metric, r.latency_ms AS ms FROM once
    UNION ALL SELECT r.started_at::DATE, r.arm, 'stages/' || e.key, e.value FROM (SELECT r, unnest(map_entries(r.stages)) AS e FROM once)),
  sketch AS (SELECT day, arm, metric, CASE WHEN ms = 0 THEN 0 ELSE sign(ms)::BIGINT * (ceil(ln(abs(ms)) / {math.log(_GAMMA)!r})::BIGINT + {_OFFSET}) END AS bucket, count(*) AS n
    FROM t WHERE (stored OR ms >= 0) AND NOT isnan(ms) AND NOT isinf(ms) GROUP BY 1, 2, 3, 4)"""


def _p4_sql(day: str | None, stored: bool = False) -> str:
    by = f"{day}, arm, metric" if day else "arm, metric"
    months = ", s AS (SELECT *, strftime(day, '%Y-%m') AS month FROM sketch)"
    value = lambda b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE round(sign({b}) * exp((abs({b}) - {_OFFSET}) * {math.log(_GAMMA)!r} + {math.log(2 / (1 + _GAMMA))!r}), 6) END"
    points = ", ".join(value(f"min(bucket) FILTER (upto >= greatest(1, ceil(total * {q} / 100.0)))") + f" AS p{q}" for q in POINTS)
    return f"""{_P4_SKETCH.replace("stored OR", str(stored) + " OR")}{months}, m AS (SELECT {by}, bucket, sum(n)::BIGINT AS n FROM s GROUP BY {by}, bucket),
      u AS (SELECT *, sum(n) OVER (PARTITION BY {by}) AS total, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto FROM m)
    SELECT {by}, max(total)::BIGINT AS n, {points} FROM u GROUP BY {by}"""


P4_SQL = {
    "p4_percentiles_stored": _p4_sql(None, stored=True),
    "p4_day_sketch": f"{_P4_SKETCH.replace('stored OR', 'false OR')} SELECT day, arm, metric, bucket, n FROM sketch",
    "p4_percentiles": _p4_sql(None),
    "p4_percentiles_by_day": _p4_sql("day"),
    "p4_percentiles_by_month": _p4_sql("month"),
}

# ---------------------------------------------------------------- 5: mention texts mapped to entities
def _meant(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The mentions with text, each once, and what each text means."""
    mentions = read_table(spark, d, "mention").select("mention_id", "text").where("mention_id IS NOT NULL AND text IS NOT NULL").distinct()
    names = canonical.reference_names(read_table(spark, d, "entity"), "iri", [F.array("label"), F.col("labels")], "popularity")
    return mentions, canonical.closest(mentions, "text", materialize(names, "names"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    mentions, meant = _meant(spark, d)
    return mentions.join(meant, "text").select("mention_id", F.coalesce("key", F.lit("none")).alias("iri")).distinct()


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Texts that mean no entity, with the number of mentions."""
    mentions, meant = _meant(spark, d)
    return mentions.join(meant.where("key IS NULL"), "text").groupBy("text").agg(F.count(F.lit(1)).alias("mentions"))


def _form_sql(x: str) -> str:
    """name_form for texts in Latin letters."""
    return f"trim(regexp_replace(regexp_replace(lower(strip_accents({x})), '[''’`´]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


_P5 = f"""WITH m AS (SELECT DISTINCT mention_id, text, {_form_sql("text")} AS form FROM mention WHERE mention_id IS NOT NULL AND text IS NOT NULL),
  n0 AS (SELECT iri, coalesce(popularity, -1) AS w, {_form_sql("name")} AS form FROM (SELECT iri, popularity, unnest(list_append(coalesce(labels, []), label)) AS name FROM entity) WHERE iri IS NOT NULL AND name IS NOT NULL),
  n AS (SELECT form, arg_min(iri, (-w, iri)) AS iri FROM n0 WHERE form <> '' GROUP BY form),
  o AS (SELECT DISTINCT form FROM m WHERE form <> '' AND form NOT IN (SELECT form FROM n)),
  vt AS (SELECT DISTINCT form, substr(' ' || form || ' ', unnest(range(1, length(form) + 2)), 2) AS t FROM o),
  nt AS (SELECT DISTINCT form, substr(' ' || form || ' ', unnest(range(1, length(form) + 2)), 2) AS t FROM n),
  vn AS (SELECT form, count(*) AS k FROM vt GROUP BY 1), nn AS (SELECT form, count(*) AS k FROM nt GROUP BY 1),
  c AS (SELECT vt.form AS v, nt.form AS other, count(*) AS k FROM vt JOIN nt USING (t) GROUP BY 1, 2),
  j AS (SELECT v, other, c.k / (vn.k + nn.k - c.k) AS j FROM c JOIN vn ON vn.form = v JOIN nn ON nn.form = other),
  b AS (SELECT v AS form, arg_min(iri, (-round(j, 9), iri)) AS iri FROM j JOIN n ON n.form = other WHERE j >= {canonical.NEAR} - 1e-9 GROUP BY 1),
  f AS (SELECT m.*, coalesce(n.iri, b.iri, 'none') AS iri FROM m LEFT JOIN n USING (form) LEFT JOIN b USING (form))"""

# ---------------------------------------------------------------- 6: items that differ in form only
def _items(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("string")
    def form(question: pd.Series, sparql: pd.Series) -> pd.Series:
        return pd.Series([record_form(q, s) for q, s in zip(question, sparql, strict=True)], dtype=object)

    return read_table(spark, d, "benchmark_item").select("row_id", form("question", "gold_sparql").alias("form"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    runs = formatcopies.equal_runs(_items(spark, d), "form", "row_id")
    return runs.where("keep <> row_id").select(F.col("keep").alias("keep_id"), F.col("row_id").alias("copy_id"))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """One row per item with its number of copies."""
    return formatcopies.copy_counts(formatcopies.equal_runs(_items(spark, d), "form", "row_id")).withColumnRenamed("keep", "row_id")


# ---------------------------------------------------------------- 7: documents packed into containers
def _capacities(spark: SparkSession, d: str) -> dict[int, int]:
    """The specs, a table of settings."""
    return {r["spec_id"]: r["capacity_tokens"] for r in read_table(spark, d, "pack_spec").orderBy("spec_id").collect()}


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    docs = tokens.with_tokens(read_table(spark, d, "documents").select("doc_id", "text"), "text")
    return packing.pack(docs, "doc_id", "tokens", _capacities(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_containers(spark, d), _capacities(spark, d))


def p7_violations(spark: SparkSession, d: str) -> DataFrame:
    """What a right packing has none of, counted per spec: documents without exactly their tokens placed once in order,
    documents cut though they fit, containers over capacity, and whether there is more than one container in a thousand
    beyond the least number that could hold all tokens, and more than two."""
    caps = _capacities(spark, d)
    docs = materialize(tokens.with_tokens(read_table(spark, d, "documents").select("doc_id", "text"), "text"), "sized")
    placed = materialize(packing.pack(docs, "doc_id", "tokens", caps), "placed")
    specs = read_table(spark, d, "pack_spec").select(F.col("spec_id").cast("long").alias("spec"), F.col("capacity_tokens").alias("capacity"))
    by_item = Window.partitionBy("spec", "doc_id").orderBy("token_start", "token_end")
    joined = placed.withColumn("before", F.lag("token_end", 1, 0).over(by_item)).groupBy("spec", "doc_id").agg(F.max("token_end").alias("upto"), F.count_if(F.col("before") != F.col("token_start")).alias("gaps"), F.count(F.lit(1)).alias("pieces"))
    items = docs.crossJoin(F.broadcast(specs)).join(joined, ["spec", "doc_id"], "left")
    unplaced = ~F.coalesce((F.col("upto") == F.col("tokens")) & (F.col("gaps") == 0), F.lit(False))
    one = items.groupBy("spec").agg(F.count_if(unplaced).alias("unplaced"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("cut"))
    load = placed.where("container IS NOT NULL").groupBy("spec", "container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("load")).join(F.broadcast(specs), "spec")
    two = load.groupBy("spec").agg(F.count_if(F.col("load") > F.col("capacity")).alias("overfull"), (F.count(F.lit(1)) - F.ceil(F.sum("load") / F.max("capacity"))).alias("more"), F.count(F.lit(1)).alias("containers"))
    return specs.join(one, "spec", "left").join(two, "spec", "left").select("spec", F.coalesce("unplaced", F.lit(0)).alias("unplaced"), F.coalesce("cut", F.lit(0)).alias("cut"), F.coalesce("overfull", F.lit(0)).alias("overfull"), ((F.col("more") > 2) & (F.col("more") > F.col("containers") / 1000)).alias("too_many"))


# ---------------------------------------------------------------- 8: sources mixed to target shares
def _mixed_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their size, primary language and, as topic, the class of the model they are on."""
    docs = read_table(spark, d, "documents").select("doc_id", "source", F.regexp_extract(F.lower(F.trim("lang")), "^([a-z]{2,3})(?:[-_].*)?$", 1).alias("lang"), F.upper(F.trim("item")).alias("code"), "text")
    model = read_table(spark, d, "vehicle_model").groupBy(F.upper(F.trim("model_code")).alias("code")).agg(F.min("model_class").alias("topic"))
    sized = tokens.with_tokens(docs, "text")
    return sized.join(model, "code", "left").select("doc_id", "source", "lang", "topic", "tokens")


def p8_draws(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(materialize(_mixed_docs(spark, d), "sized"), read_table(spark, d, "mix_target"), "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p8_draws(spark, d), read_table(spark, d, "mix_target"))


#: Shares of languages and topics asked for, to be met as far as the sources allow.
MARGINALS = {"lang": {"en": 0.7, "de": 0.2, "fr": 0.1}}


def p8_marginals(spark: SparkSession, d: str) -> DataFrame:
    """Target, planned and actual shares of sources, languages and topics, with languages raked to MARGINALS."""
    docs, targets = materialize(_mixed_docs(spark, d), "sized"), read_table(spark, d, "mix_target")
    _, planned, _ = mixing.fit(docs.withColumn("doc", F.col("doc_id")), targets, MARGINALS)
    return mixing.marginal_shares(mixing.mix(docs, targets, "doc_id", marginals=MARGINALS, cells=True), planned)


def p8_fit(spark: SparkSession, d: str) -> DataFrame:
    """Rounds of fitting per mix, and the last change of a weight as a part of its cap."""
    _, _, how = mixing.fit(materialize(_mixed_docs(spark, d), "sized").withColumn("doc", F.col("doc_id")), read_table(spark, d, "mix_target"))
    kind = dict(read_table(spark, d, "mix_target").dtypes)["mix_id"]
    return spark.createDataFrame(list(how.itertuples(index=False)), f"mix_id {kind}, rounds long, last_change double").select("mix_id", "rounds", F.round("last_change", 12).alias("last_change"))


def p8_violations(spark: SparkSession, d: str) -> DataFrame:
    """What a right mix has none of, counted per target: documents used too often or of another source, a repeated
    row, and a share further from its target than one document, where the source has documents to draw."""
    docs, targets = materialize(_mixed_docs(spark, d), "sized"), read_table(spark, d, "mix_target")
    drawn = materialize(mixing.mix(docs, targets, "doc_id"), "drawn")
    used = drawn.groupBy("mix_id", "doc_id").agg(F.count(F.lit(1)).alias("rows"), F.first("source").alias("source"), F.max("repeats").alias("repeats"))
    checked = used.join(targets, ["mix_id", "source"], "left").join(docs.select("doc_id", F.col("source").alias("true_source")), "doc_id", "left")
    wrong = checked.groupBy("mix_id", "source").agg(F.count_if(~F.coalesce(F.col("repeats") <= F.col("max_repeats"), F.lit(False))).alias("overused"), F.count_if((F.col("rows") > 1) | ~F.col("source").eqNullSafe(F.col("true_source"))).alias("misplaced"))
    has = docs.where("tokens > 0").groupBy("source").agg(F.max("tokens").alias("longest"))
    sized = targets.join(has, "source", "left").join(drawn.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("got")), ["mix_id", "source"], "left")
    of = Window.partitionBy("mix_id")
    able = F.when(F.col("longest").isNotNull(), F.col("target_share")).otherwise(0.0)
    total = F.sum(F.coalesce("got", F.lit(0))).over(of)
    # One document more or less in a source, and the total off by one document of each source.
    room = F.coalesce("longest", F.lit(0)) + able / F.sum(able).over(of) * F.sum(F.coalesce("longest", F.lit(0))).over(of)
    missed = (F.abs(F.coalesce("got", F.lit(0)) - able / F.sum(able).over(of) * total) > room).cast("long")
    return sized.withColumn("missed", missed).join(wrong, ["mix_id", "source"], "left").select("mix_id", "source", F.coalesce("overused", F.lit(0)).alias("overused"), F.coalesce("misplaced", F.lit(0)).alias("misplaced"), F.coalesce("missed", F.lit(0)).alias("missed"))


# ---------------------------------------------------------------- 9: long exact spans in several documents
SPAN = 150


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sharedspans.shared_spans(read_table(spark, d, "documents"), "doc_id", "text", SPAN)


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return sharedspans.shared_share(docs, sharedspans.shared_spans(docs, "doc_id", "text", SPAN), "doc_id", "text")


QUERIES = {
    "p2_found": p2_found,
    "p4_percentiles_by_day": p4_percentiles_by_day,
    "p4_percentiles": p4_percentiles,
    "p4_percentiles_by_month": p4_percentiles_by_month,
    "p4_percentiles_stored": p4_percentiles_stored,
    "p4_day_sketch": p4_day_sketch,
    "p5_found": p5_found,
    "p5_unmatched": p5_unmatched,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p7_violations": p7_violations,
    "p8_draws": p8_draws,
    "p8_shares": p8_shares,
    "p8_marginals": p8_marginals,
    "p8_fit": p8_fit,
    "p8_violations": p8_violations,
    "p9_found": p9_found,
    "p9_shared": p9_shared,
}
_SPACE = "[\\s\\p{Z}]"
_PREFIX = f"prefix{_SPACE}+[^\\s:]*{_SPACE}*:{_SPACE}*<[^>]*>"
#: Patterns are told apart by a dot before white space; right for these tables, where no string holds one.
_P6 = f"""WITH f AS (SELECT row_id, lower(regexp_replace(question, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS q, lower(gold_sparql) AS s FROM benchmark_item),
  p AS (SELECT row_id, q, list_sort(list_transform(regexp_extract_all(s, '{_PREFIX}'), lambda x: regexp_replace(x, '{_SPACE}', '', 'g'))) AS prefixes, regexp_replace(s, '{_PREFIX}', '', 'g') AS rest FROM f),
  k AS (SELECT row_id, q, prefixes, regexp_replace(regexp_extract(rest, '^([^{{]*)', 1), '{_SPACE}', '', 'g') AS head,
    list_sort(list_filter(list_transform(regexp_split_to_array(regexp_extract(rest, '^[^{{]*\\{{(.*)\\}}', 1, 's'), '\\.({_SPACE}+|$)'), lambda x: regexp_replace(x, '{_SPACE}', '', 'g')), lambda x: x <> '')) AS body FROM p),
  c AS (SELECT row_id, min(row_id) OVER (PARTITION BY q, prefixes, head, body) AS keep FROM k)"""
#: Every stretch of every text: for small tables.
_P9 = f"""WITH s AS (SELECT doc_id, unnest(range(0, length(text) - {SPAN - 1})) AS a, text FROM documents WHERE length(text) >= {SPAN}),
  h AS (SELECT doc_id, a, substr(text, a + 1, {SPAN}) AS t FROM s), m AS (SELECT t FROM h GROUP BY t HAVING min(doc_id) < max(doc_id)),
  x AS (SELECT doc_id, a FROM h WHERE t IN (SELECT t FROM m)),
  n AS (SELECT doc_id, a, CASE WHEN a <= lag(a) OVER w + {SPAN} THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
  i AS (SELECT doc_id, a, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS island FROM n),
  found AS (SELECT doc_id, min(a) AS span_start, max(a) + {SPAN} AS span_end FROM i GROUP BY doc_id, island)"""
SQL = {
    "p2_found": P2_SQL,
    **P4_SQL,
    "p5_found": f"{_P5} SELECT DISTINCT mention_id, iri FROM f",
    "p5_unmatched": f"{_P5} SELECT text, count(*) AS mentions FROM f WHERE iri = 'none' GROUP BY 1",
    "p6_found": f"{_P6} SELECT keep AS keep_id, row_id AS copy_id FROM c WHERE keep <> row_id",
    "p6_items": f"{_P6} SELECT keep AS row_id, count(*) AS copies FROM c GROUP BY 1",
    # Invariants: the queries count what breaks them in the real results, over all documents.
    "p7_violations": "SELECT spec_id::BIGINT AS spec, 0 AS unplaced, 0 AS cut, 0 AS overfull, false AS too_many FROM pack_spec",
    "p8_violations": "SELECT mix_id, source, 0 AS overused, 0 AS misplaced, 0 AS missed FROM mix_target",
    "p9_found": f"{_P9} SELECT doc_id, span_start, span_end FROM found",
    "p9_shared": f"""{_P9}, t AS (SELECT doc_id, sum(span_end - span_start) AS c, count(*) AS k FROM found GROUP BY 1)
      SELECT d.doc_id, coalesce(length(text), 0) AS n_chars, coalesce(c, 0)::BIGINT AS shared_chars, coalesce(k, 0) AS spans,
        CASE WHEN length(text) > 0 THEN coalesce(c, 0) / length(text) ELSE 0.0 END AS shared_fraction FROM documents d LEFT JOIN t USING (doc_id)""",
}
