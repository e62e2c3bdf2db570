"""Text, retrieval and metric queries over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..evaluation import metrics
from ..functions.literals import literals_udf
from ..functions.text import SUFFIXES, jaccard_col, normalize_col, softmax_col, stems_col, tokens_col, trigrams_col
from ..operators.deliveries import one_delivery
from ..operators.retrieval import bm25_search, bm25_top, nearest_vectors, trigram_matches
from ..runtime import read_table

QUERIES, SQL = {}, {}
# What is searched for.
SEARCHES = [(1, "brake pedal noise in city traffic"), (2, "battery range on a camping tour"), (3, "Getriebe war laut"), (4, "floor mat sticky")]


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """The normal forms of all names of every entity."""
    e = read_table(spark, d, "entity")
    names = F.explode(F.concat(F.array("label"), F.coalesce("labels", F.array().cast("array<string>"))))
    return e.select("iri", names.alias("name")).select("iri", normalize_col(F.col("name")).alias("norm")).distinct()


def stem_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Stems of titles and whole texts, with how often each stands there."""
    docs = read_table(spark, d, "documents").select(F.explode(F.array("title", "text")).alias("t"))
    return docs.select(F.explode(stems_col(F.col("t"))).alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


def literal_extraction(spark: SparkSession, d: str) -> DataFrame:
    q = read_table(spark, d, "benchmark_item").select("row_id", F.explode(literals_udf("question")).alias("l"))
    return q.select("row_id", "l.*")


def literal_quarters(spark: SparkSession, d: str) -> DataFrame:
    """Quarters of the years in which orders were placed, as periods: each order's quarter found again in text."""
    o = read_table(spark, d, "orders").select(F.concat(F.lit("orders of Q"), F.quarter("o_orderdate"), F.lit(" "), F.year("o_orderdate")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("orders"))
    return o.select("orders", F.explode(literals_udf("text")).alias("l")).select("l.low", "l.high", "orders")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    asked = spark.createDataFrame(SEARCHES, "query int, text string")
    got = bm25_top(docs, "doc_id", tokens_col(F.col("text")), asked, "query", tokens_col(F.col("text")), 10)
    return got.withColumn("score", F.round("score", 6))


def bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    """Queries: the whole text of every document whose id is divisible by 20, against all documents."""
    docs = read_table(spark, d, "documents")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), "text")
    return bm25_search(docs, "doc_id", tokens_col(F.col("text")), asked, "query", tokens_col(F.col("text")), 10)


def trigram_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Queries: the text of every mention whose id is divisible by 20, against all names of entities."""
    asked = read_table(spark, d, "mention").where("mention_id % 20 = 0").select(F.col("text").alias("query"))
    return trigram_matches(asked, "query", read_table(spark, d, "entity"), "label").withColumn("similarity", F.round("similarity", 6))


def trigram_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each mention's text and the label of each of its candidates."""
    m = read_table(spark, d, "mention").select("mention_id", "text", F.explode("candidates.label").alias("label")).where("text IS NOT NULL AND label IS NOT NULL").distinct()
    return m.select("mention_id", "label", F.round(jaccard_col(trigrams_col(F.col("text")), trigrams_col(F.col("label"))), 6).alias("similarity"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 20, against all."""
    e = read_table(spark, d, "embeddings")
    got = nearest_vectors(e, "vec_id", "embedding", e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding"), "query", 6)
    return got.withColumn("cosine", F.round("cosine", 6))


def softmax_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Scores of each mention's inline candidates as probabilities."""
    m = read_table(spark, d, "mention").select("mention_id", F.explode("candidates").alias("c")).select("mention_id", "c.iri", "c.score").where("score IS NOT NULL AND NOT isnan(score)").distinct()
    return m.select("mention_id", "iri", "score", F.round(softmax_col(F.col("score"), Window.partitionBy("mention_id"), 0.6), 6).alias("p"))


def beam_topk(spark: SparkSession, d: str) -> DataFrame:
    """The two most confident gates of each run with their share of the run's confidence."""
    r = read_table(spark, d, "eval_run").select("run_id", F.explode("gates").alias("g")).where("g.confidence IS NOT NULL AND NOT isnan(g.confidence)").select("run_id", "g.name", "g.confidence").distinct()
    shared = metrics.shares(r, ["run_id"], "confidence")
    w = Window.partitionBy("run_id").orderBy(F.col("confidence").desc(), F.col("name").asc_nulls_last())
    return shared.withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("run_id", "name", "rank", F.round("share", 6).alias("share"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    once = one_delivery(read_table(spark, d, "eval_run").select("run_id", "item_id", "arm", "status", "shape", "latency_ms", "stages", "gates", "loaded_at"), "run_id", ["loaded_at"]).drop("loaded_at")
    items = read_table(spark, d, "benchmark_item").select(F.col("row_id").alias("item_id"), "tags", "expect_unanswered", F.col("gold.shape").alias("gold_shape"))
    return once.join(items, "item_id", "left").withColumn("correct", F.col("shape").eqNullSafe(F.col("gold_shape")))


_RUNS = """once AS (SELECT run_id, arg_min(struct_pack(item_id := item_id, arm := arm, status := status, shape := shape, latency_ms := latency_ms, stages := stages, gates := gates), loaded_at) AS r FROM eval_run WHERE run_id IS NOT NULL GROUP BY 1),
  runs AS (SELECT run_id, r.item_id AS item_id, r.arm AS arm, r.status AS status, r.shape AS shape, r.latency_ms AS latency_ms, r.stages AS stages, r.gates AS gates, tags, expect_unanswered, gold.shape AS gold_shape, r.shape IS NOT DISTINCT FROM gold.shape AS correct
    FROM once LEFT JOIN benchmark_item ON row_id = r.item_id)"""


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    got = metrics.summarize(_runs(spark, d).withColumn("f1", F.col("correct").cast("double")), ["arm"])
    return got.select("arm", "runs", *[F.round(c, 6).alias(c) for c in got.columns if c not in ("arm", "runs")])


def eval_percentiles(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.groupBy("event_type").agg(*[F.round(metrics.percentile(F.col("value"), q), 6).alias(f"p{int(100 * q)}") for q in (0.5, 0.9, 0.95)])


def eval_accuracy_f1(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of each mention as an answer to what its table of candidates holds."""
    m = read_table(spark, d, "mention").where("candidates IS NOT NULL").select("mention_id", F.transform("candidates", lambda c: c["label"]).alias("got"))
    m = m.groupBy("mention_id").agg(F.min("got").alias("got"))
    gold = read_table(spark, d, "candidate").groupBy("mention_id").agg(F.collect_set("label").alias("gold"))
    both = m.join(gold, "mention_id")
    return both.select("mention_id", metrics.exact_match(F.col("got"), F.col("gold")).alias("exact"), F.round(metrics.f1(F.col("got"), F.col("gold")), 6).alias("f1"))


def _confident(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("arm", F.explode("gates").alias("g")).select("arm", F.col("g.confidence").alias("c"), F.col("g.passed").alias("ok"))


def eval_reliability(spark: SparkSession, d: str) -> DataFrame:
    got = metrics.reliability(_confident(spark, d), F.col("c"), F.col("ok"), ["arm"])
    return got.select("arm", "bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


def eval_calibration(spark: SparkSession, d: str) -> DataFrame:
    bins = metrics.reliability(_confident(spark, d), F.col("c"), F.col("ok"), ["arm"])
    return metrics.calibration_error(bins, ["arm"]).withColumn("ece", F.round("ece", 6))


def eval_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return metrics.by_tag(_runs(spark, d), "tags", F.col("correct")).withColumn("accuracy", F.round("accuracy", 6))


def stage_seconds(spark: SparkSession, d: str) -> DataFrame:
    return metrics.stage_means(_runs(spark, d), ["arm"]).withColumn("seconds", F.round("seconds", 9))


def failure_attribution(spark: SparkSession, d: str) -> DataFrame:
    r = _runs(spark, d)
    gate = lambda name: F.forall(F.filter(F.coalesce("gates", F.array().cast(r.schema["gates"].dataType)), lambda g: g["name"] == name), lambda g: F.coalesce(g["passed"], F.lit(True)))
    status = F.coalesce("status", F.lit(""))
    f = metrics.attribute_failure(
        {
            "correct": F.col("correct"), "unanswerable": F.coalesce("expect_unanswered", F.lit(False)), "answered": status == "answered", "timeout": status == "timeout", "error": status == "error",
            "fallback": status == "fallback", "entities": gate("entity"), "module": gate("module"), "class": gate("class"), "shape": F.col("correct"), "properties": gate("plan"), "gated": F.lit(False),
        }
    )
    return r.groupBy("arm", f.alias("failure")).agg(F.count(F.lit(1)).alias("n"))


for _f in (normalize_text, stem_tokens, literal_extraction, literal_quarters, bm25_topk, bm25_documents, trigram_fuzzy, trigram_pairs, vector_topk, softmax_normalize, beam_topk, eval_summary, eval_percentiles, eval_accuracy_f1, eval_reliability, eval_calibration, eval_by_tag, stage_seconds, failure_attribution):
    QUERIES[_f.__name__] = _f

_NORM = "trim(regexp_replace(lower(regexp_replace(strip_accents({}), '[''’]s\\b', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_TRIGRAMS = "list_distinct([substr('  ' || {0} || ' ', i, 3) FOR i IN range(1, length({0}) + 2)])"


def _stop() -> str:
    from ..functions.text import STOPWORDS

    return ", ".join(f"'{w}'" for w in sorted(STOPWORDS))


def _words(c: str) -> str:
    norm = _NORM.format(f"replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' ')")
    return f"list_filter(string_split({norm}, ' '), lambda w: w <> '' AND w NOT IN ({_stop()}))"


#: Suffixes as cases; an answer's compared values: days, numbers to two places, other text trimmed and in lower case.
_ENDINGS = " ".join(f"WHEN w LIKE '%{end}' AND length(w) >= {least} THEN left(w, length(w) - {len(end)}) || '{put}'" for end, put, least in SUFFIXES)
_ANSWERS = "list_sort(list_distinct(list_transform({0}, lambda v: CASE WHEN regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ].*)?$') THEN left(v, 10) ELSE coalesce(round(TRY_CAST(v AS DOUBLE), 2)::VARCHAR, lower(trim(v))) END)))"
SQL.update(
    {
        "normalize_text": f"SELECT DISTINCT iri, {_NORM.format('name')} AS norm FROM (SELECT iri, unnest(list_prepend(label, coalesce(labels, []))) AS name FROM entity)",
        "stem_tokens": f"""WITH t AS (SELECT unnest([title, text]) AS t FROM documents), w AS (SELECT unnest({_words('t')}) AS w FROM t),
          c AS (SELECT w, CASE WHEN length(w) < 4 OR regexp_full_match(w, '[0-9]+') OR w LIKE '%ss' THEN w {_ENDINGS} ELSE w END AS c FROM w),
          s AS (SELECT CASE WHEN length(w) < 4 OR regexp_full_match(w, '[0-9]+') THEN w WHEN c LIKE '%e' AND length(c) > 3 THEN left(c, length(c) - 1) ELSE c END AS stem FROM c)
          SELECT stem, count(*) AS n FROM s GROUP BY 1""",
        "trigram_fuzzy": f"""WITH q AS (SELECT DISTINCT text AS query, {_TRIGRAMS.format(_NORM.format('text'))} AS a FROM mention WHERE mention_id % 20 = 0 AND text IS NOT NULL),
          n AS (SELECT name, {_TRIGRAMS.format('name')} AS b FROM (SELECT DISTINCT {_NORM.format('label')} AS name FROM entity) WHERE name <> ''),
          s AS (SELECT query, name, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS similarity FROM q, n),
          k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, name) AS rank FROM s WHERE similarity >= 0.72)
          SELECT query, name, round(similarity, 6) AS similarity, rank FROM k WHERE rank <= 5""",
        "eval_accuracy_f1": f"""WITH m AS (SELECT mention_id, min(list_transform(candidates, lambda c: c.label)) AS got FROM mention WHERE candidates IS NOT NULL GROUP BY 1), g AS (SELECT mention_id, list(DISTINCT label) FILTER (label IS NOT NULL) AS gold FROM candidate GROUP BY 1),
          b AS (SELECT mention_id, {_ANSWERS.format('got')} AS got, {_ANSWERS.format('gold')} AS gold FROM m JOIN g USING (mention_id)),
          s AS (SELECT mention_id, CASE WHEN got = ['0'] THEN [] ELSE got END AS got, CASE WHEN gold = ['0'] THEN [] ELSE gold END AS gold FROM b)
          SELECT mention_id, got = gold AS exact, round(CASE WHEN len(got) + len(gold) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(got, gold)) / (len(got) + len(gold)) END, 6) AS f1 FROM s""",
        "failure_attribution": f"""WITH {_RUNS}, f AS (SELECT *, coalesce(expect_unanswered, false) AS unanswerable, coalesce(status, '') AS st,
            {', '.join(f"len(list_filter(coalesce(gates, []), lambda g: g.name = '{g}' AND NOT coalesce(g.passed, true))) = 0 AS {g}" for g in ('entity', 'module', 'class', 'plan'))} FROM runs)
          SELECT arm, CASE WHEN correct THEN NULL WHEN unanswerable AND st = 'answered' THEN 'silent_answer' WHEN st = 'timeout' THEN 'execution_timeout' WHEN NOT entity THEN 'entity_linking' WHEN NOT module THEN 'routing_module'
            WHEN NOT class THEN 'routing_class' ELSE 'query_shape' END AS failure, count(*) AS n FROM f GROUP BY 1, 2""",

        "literal_quarters": "SELECT date_trunc('quarter', o_orderdate)::DATE AS low, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS high, count(*) AS orders FROM orders GROUP BY 1, 2",
        "bm25_topk": f"""WITH d AS (SELECT doc_id, coalesce({_words('text')}, []) AS w FROM documents),
          s AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d), t AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM d),
          p AS (SELECT doc_id, term, count(*) AS tf, max(length) AS length FROM t GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
          q AS (SELECT query, unnest(list_distinct({_words('text')})) AS term FROM (VALUES {', '.join(f"({i}, '{t}')" for i, t in SEARCHES)}) v(query, text)),
          r AS (SELECT query, doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM p JOIN f USING (term) JOIN q USING (term), s GROUP BY 1, 2),
          k AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM r)
          SELECT query, doc_id, round(score, 6) AS score, rank FROM k WHERE rank <= 10""",
        "bm25_documents": f"""WITH d AS (SELECT doc_id, coalesce({_words('text')}, []) AS w FROM documents),
          s AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d), t AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM d),
          p AS (SELECT doc_id, term, count(*) AS tf, max(length) AS length FROM t GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
          q AS (SELECT doc_id AS query, term FROM p WHERE doc_id % 20 = 0),
          r AS (SELECT query, p.doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM p JOIN f USING (term) JOIN q USING (term), s GROUP BY 1, 2),
          k AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM r)
          SELECT query, doc_id, score, rank FROM k WHERE rank <= 10""",
        "trigram_pairs": f"""WITH m AS (SELECT DISTINCT mention_id, text, c.label AS label FROM (SELECT mention_id, text, unnest(candidates) AS c FROM mention) WHERE text IS NOT NULL AND c.label IS NOT NULL),
          g AS (SELECT mention_id, label, {_TRIGRAMS.format(_NORM.format('text'))} AS a, {_TRIGRAMS.format(_NORM.format('label'))} AS b FROM m)
          SELECT mention_id, label, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM g""",
        "vector_topk": """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query, n.vec_id, list_cosine_similarity(q.e, n.e) AS c FROM n, n q WHERE q.vec_id % 20 = 0),
          k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, vec_id) AS rank FROM s) SELECT query, vec_id, round(c, 6) AS cosine, rank FROM k WHERE rank <= 6""",
        "softmax_normalize": """WITH m AS (SELECT DISTINCT mention_id, c.iri AS iri, c.score AS score FROM (SELECT mention_id, unnest(candidates) AS c FROM mention) WHERE c.score IS NOT NULL AND NOT isnan(c.score)),
          e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY mention_id)) / 0.6) AS x FROM m) SELECT mention_id, iri, score, round(x / sum(x) OVER (PARTITION BY mention_id), 6) AS p FROM e""",
        "beam_topk": """WITH g AS (SELECT DISTINCT run_id, g.name AS name, g.confidence AS c FROM (SELECT run_id, unnest(gates) AS g FROM eval_run) WHERE g.confidence IS NOT NULL AND NOT isnan(g.confidence)),
          k AS (SELECT run_id, name, row_number() OVER (PARTITION BY run_id ORDER BY c DESC, name NULLS LAST) AS rank, c / sum(c) OVER (PARTITION BY run_id) AS share FROM g) SELECT run_id, name, rank, round(share, 6) AS share FROM k WHERE rank <= 2""",
        "eval_summary": f"""WITH {_RUNS}, v AS (SELECT *, CASE WHEN NOT isnan(latency_ms) AND latency_ms >= 0 THEN latency_ms END AS l FROM runs)
          SELECT arm, count(*) AS runs, round(avg(correct::INT), 6) AS accuracy, round(avg(correct::INT), 6) AS f1, {', '.join(f"round(avg((status = '{s}')::INT), 6) AS {s}" for s in ('answered', 'no_data', 'fallback', 'unanswered', 'error'))},
          round(quantile_cont(l, 0.5), 6) AS p50, round(quantile_cont(l, 0.95), 6) AS p95 FROM v GROUP BY arm""",
        "eval_percentiles": "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{int(100 * q)}" for q in (0.5, 0.9, 0.95)) + " FROM events GROUP BY 1",
        "eval_reliability": f"""WITH {_RUNS}, g AS (SELECT arm, unnest(gates) AS g FROM runs), v AS (SELECT arm, g.confidence AS c, g.passed::INT AS ok FROM g WHERE g.confidence IS NOT NULL AND NOT isnan(g.confidence) AND g.passed IS NOT NULL)
          SELECT arm, greatest(0, least(floor(c * 5), 4))::INT AS bin, count(*) AS n, round(avg(c), 6) AS confidence, round(avg(ok), 6) AS accuracy FROM v GROUP BY 1, 2""",
        "eval_calibration": f"""WITH {_RUNS}, g AS (SELECT arm, unnest(gates) AS g FROM runs), v AS (SELECT arm, g.confidence AS c, g.passed::INT AS ok FROM g WHERE g.confidence IS NOT NULL AND NOT isnan(g.confidence) AND g.passed IS NOT NULL),
          b AS (SELECT arm, greatest(0, least(floor(c * 5), 4)) AS bin, count(*) AS n, avg(c) AS conf, avg(ok) AS acc FROM v GROUP BY 1, 2) SELECT arm, round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM b GROUP BY 1""",
        "eval_by_tag": f"WITH {_RUNS}, t AS (SELECT unnest(list_distinct(tags)) AS tag, correct::INT AS ok FROM runs) SELECT tag, count(*) AS n, round(avg(ok), 6) AS accuracy FROM t GROUP BY 1",
        "stage_seconds": f"WITH {_RUNS}, s AS (SELECT arm, unnest(map_entries(stages)) AS e FROM runs) SELECT arm, e.key AS stage, round(avg(e.value) / 1000, 9) AS seconds, count(*) AS n FROM s WHERE e.value IS NOT NULL AND NOT isnan(e.value) GROUP BY 1, 2",
    }
)
