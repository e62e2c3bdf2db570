"""Ranked retrieval: BM25, trigram similarity, cosine of vectors."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import jaccard_col, normalize_col, trigrams_col
from ..runtime import materialize

K1, B = 1.2, 0.75


def bm25_top(docs: DataFrame, doc: str, words: Column, queries: DataFrame, query: str, query_words: Column, k: int) -> DataFrame:
    """``query, doc, score, rank``: the ``k`` best documents of each query with a positive score; ties by document.

    A query's terms count once each. Statistics cover all documents, those without terms too. Words are written once;
    they are cut to the queries' terms as they are taken apart, before anything is counted or shuffled, so no posting of
    another term leaves its task. Scores are partial sums per (query, document).
    """
    d = materialize(docs.select(F.col(doc).alias("doc"), words.alias("w")).where("doc IS NOT NULL"), "words")
    lengths = d.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.greatest(F.size("w"), F.lit(0))).alias("mean"))
    wanted = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(query_words)).alias("term"))
    terms = wanted.select("term").distinct()
    flat = d.select("doc", F.size("w").alias("length"), F.explode("w").alias("term")).join(terms, "term", "left_semi")
    hits = materialize(flat.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length")), "hits")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.when(F.col("mean") > 0, F.col("mean")).otherwise(1))
    idf = df.crossJoin(F.broadcast(lengths)).select("term", weight.alias("idf"), "mean")  # one row of totals
    scored = hits.join(idf, "term").select("doc", "term", (F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("part"))
    total = scored.join(wanted, "term").groupBy("query", "doc").agg(F.sum("part").alias("score")).where("score > 0")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("query").alias(query), F.col("doc").alias(doc), "score", "rank")


#: Text queries sent to the tasks at once, documents scored at once, and the weight below which a term is common (in 5 %
#: of the documents or more): common terms are multiplied as matrices, others added where they stand.
TEXT_BLOCK, DOC_BLOCK, COMMON = 4096, 1024, 3.0


def bm25_search(docs: DataFrame, doc: str, words: Column, queries: DataFrame, query: str, query_words: Column, k: int, digits: int = 6) -> DataFrame:
    """:func:`bm25_top` for many or long queries: scores are rounded to ``digits`` before they are ranked; ties by document.

    Words are written once. Queries go to the tasks in blocks of TEXT_BLOCK with the weights of their terms, each block
    one scan of the words; a task scores whole documents and keeps, per query, those that may be among the ``k`` best
    of all it has seen, so nothing is shuffled per pair. Queries come to the driver block by block.
    """
    d = materialize(docs.select(F.col(doc).alias("doc"), words.alias("w")).where("doc IS NOT NULL"), "words")
    totals = d.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.greatest(F.size("w"), F.lit(0))).alias("mean"))
    df = d.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(totals)).select("term", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # one row of totals
    wanted = queries.select(F.col(query).alias("q"), F.explode(F.array_distinct(query_words)).alias("term")).where("q IS NOT NULL").distinct()
    asked = materialize(wanted.join(idf, "term").groupBy("q").agg(F.collect_list(F.struct("term", "idf")).alias("terms")), "asked")
    mean = totals.first()["mean"] or 1.0
    out = f"q {dict(queries.dtypes)[query]}, k {dict(docs.dtypes)[doc]}, score double"
    found: DataFrame | None = None
    for block in _blocks(asked.toLocalIterator(), TEXT_BLOCK):
        part = d.where("size(w) > 0").mapInArrow(_score(block, k, mean, 10.0**-digits, out), out)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = d.sparkSession.createDataFrame([], out)
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "k")
    ranked = found.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).select(F.col("q").alias(query), F.col("k").alias(doc), "score", "rank")


def _score(block: list, k: int, mean: float, slack: float, schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    ids = [r["q"] for r in block]
    # common terms first
    idf = dict(sorted(((t["term"], t["idf"]) for r in block for t in r["terms"]), key=lambda x: x[1]))
    at = {t: i for i, t in enumerate(idf)}
    pairs = np.array([(at[t["term"]], j) for j, r in enumerate(block) for t in r["terms"]], np.int64).reshape(-1, 2)
    terms, weight = list(idf), np.array(list(idf.values()))
    common = int(np.searchsorted(weight, COMMON))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, has = pa.array(terms, pa.string()), np.zeros((common, len(ids)))
        has[tuple(pairs[pairs[:, 0] < common].T)] = 1
        by = pairs[np.argsort(pairs[:, 0], kind="stable")]
        of, first = by[:, 1], np.searchsorted(by[:, 0], np.arange(len(terms) + 1))
        best, kept = np.full((len(ids), k), -np.inf), []
        for batch in batches:
            for start in range(0, batch.num_rows, DOC_BLOCK):
                part = batch.slice(start, DOC_BLOCK)
                scores = _scores(part.column(1), words, weight, has, of, first, mean)
                # what may tie with the k-th when rounded stays, so that ties are settled by document over all tasks
                least = best.min(axis=1)
                if len(scores) > k and not np.isfinite(least).any():
                    least = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
                rows, which = np.nonzero(scores >= np.maximum(least - slack, np.nextafter(0, 1)))
                if len(rows):
                    found = scores[rows, which]
                    kept.append((which, part.column(0).take(pa.array(rows)).cast(arrow.field(1).type), found))
                    best = _best(best, which, found)
        if kept:
            which, found = (np.concatenate([x[i] for x in kept]) for i in (0, 2))
            stays = np.nonzero(found >= best.min(axis=1)[which] - slack)[0]
            keys = pa.concat_arrays([x[1] for x in kept]).take(pa.array(stays))
            asked = pa.array(ids, arrow.field(0).type).take(pa.array(which[stays]))
            yield pa.RecordBatch.from_arrays([asked, keys, pa.array(found[stays])], schema=arrow)

    return run


def _scores(lists: pa.ListArray, terms: pa.Array, weight: np.ndarray, has: np.ndarray, of: np.ndarray, first: np.ndarray, mean: float) -> np.ndarray:
    """The score of each document, a list of words, for each query. ``has``: which query has which of the first, common
    terms; ``of`` from ``first[t]`` on: the queries that have term ``t``."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    term = pc.fill_null(pc.index_in(coded.dictionary.cast(terms.type), value_set=terms), -1).to_numpy(zero_copy_only=False)
    places = pc.fill_null(coded.indices, len(term)).to_numpy(zero_copy_only=False)
    term = np.append(term, -1)[places].astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    cells, n = np.unique((row * len(terms) + term)[term >= 0], return_counts=True)
    row, term = np.divmod(cells, max(1, len(terms)))
    part = weight[term] * n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[row] / mean))
    dense, common = np.zeros((len(lengths), len(has))), term < len(has)
    dense[row[common], term[common]] = part[common]
    scores = dense @ has
    row, term, part = row[~common], term[~common], part[~common]
    many = first[term + 1] - first[term]
    query = of[np.repeat(first[term] - np.cumsum(many) + many, many) + np.arange(many.sum())]
    np.add.at(scores.reshape(-1), np.repeat(row, many) * scores.shape[1] + query, np.repeat(part, many))
    return scores


def _best(best: np.ndarray, which: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The greatest scores of each query, one row each, with those found put in."""
    order = np.lexsort((-found, which))
    which, found = which[order], found[order]
    rank = np.arange(len(which)) - np.searchsorted(which, which)
    top = rank < best.shape[1]
    new = np.full_like(best, -np.inf)
    new[which[top], rank[top]] = found[top]
    return np.sort(np.concatenate([best, new], axis=1), axis=1)[:, best.shape[1] :]


def trigram_matches(queries: DataFrame, query: str, names: DataFrame, name: str, least: float = 0.72, k: int = 5) -> DataFrame:
    """``query, name, similarity, rank``: each query's ``k`` names most alike by trigrams, at least ``least``; ties by name.

    Names are distinct and normalised. Two sets of trigrams as alike as ``least`` share one of the rarest
    n - ceil(least n) + 1 trigrams of each, so only these are joined, and pairs whose sizes differ too much fall out
    before they are compared. All names are compared that may be alike enough: there is no short list. A common trigram
    joins only the names for which it is among the rarest. Queries and their sets are never broadcast: their files are far
    smaller than their rows.
    """
    q = queries.select(F.col(query).alias("query")).where("query IS NOT NULL").distinct().withColumn("text", normalize_col(F.col("query")))
    # Both are written, so that no normal form or set is made twice.
    q = materialize(q, "queries")
    texts = materialize(q.select("text").where("text <> ''").distinct().withColumn("qt", trigrams_col(F.col("text"))), "texts")
    n = names.select(normalize_col(F.col(name)).alias("name")).where("name <> ''").distinct()
    n = materialize(n.withColumn("nt", trigrams_col(F.col("name"))), "names")
    counts = n.select(F.explode("nt").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c"))

    def rare(sets: DataFrame, text: str, grams: str) -> DataFrame:
        """The rarest trigrams of each set; those in no name come first and meet none."""
        each = sets.select(text, F.size(grams).alias("size"), F.explode(grams).alias("t")).join(counts, "t", "left")
        held = each.groupBy(text).agg(F.first("size").alias(f"{grams}_n"), F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "t"))).alias("by"))
        head = F.col(f"{grams}_n") - F.ceil(F.col(f"{grams}_n") * least - 1e-9).cast("int") + 1
        return held.select(text, f"{grams}_n", F.explode(F.slice("by", 1, head)).alias("b")).where("b.c > 0").select(text, f"{grams}_n", F.col("b.t").alias("t"))

    near = (F.col("nt_n") >= F.col("qt_n") * least - 1e-9) & (F.col("qt_n") >= F.col("nt_n") * least - 1e-9)
    met = rare(texts, "text", "qt").hint("merge").join(rare(n, "name", "nt"), "t").where(near).select("text", "name").distinct()
    sets = met.join(texts.hint("merge"), "text").join(n, "name")
    scored = sets.select("text", "name", jaccard_col(F.col("qt"), F.col("nt")).alias("similarity")).where(F.col("similarity") >= least)
    w = Window.partitionBy("text").orderBy(F.col("similarity").desc(), "name")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return q.hint("merge").join(best, "text").select("query", "name", "similarity", "rank")


#: Vectors in a block: each block of queries is compared with each block of vectors by one product of matrices.
VECTOR_BLOCK = 2048


def nearest_vectors(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query: str, k: int, least: float = -1.0) -> DataFrame:
    """``query, key, cosine, rank``: each query's ``k`` vectors of greatest cosine, at least ``least``; ties by key.

    Exact: every vector is compared with every query. Both are laid out in blocks, one row each, and the rows of blocks
    are paired; nothing comes to the driver. A task keeps the best of each of its queries over all its pairs, so what is
    shuffled grows with the number of tasks, not of vectors. NULL vectors are left out; vectors without length have
    cosine 0; vectors of different lengths are an error.
    """
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where("k IS NOT NULL AND v IS NOT NULL")
    wanted = queries.select(F.col(query).alias("k"), F.col(vector).cast("array<double>").alias("v")).where("k IS NOT NULL AND v IS NOT NULL")
    key_type, query_type = dict(vectors.dtypes)[key], dict(queries.dtypes)[query]
    # The queries' blocks are written, so they are made once; Spark broadcasts them or pairs partitions, by their size.
    asked = materialize(_blocked(wanted, "q", query_type).withColumn("block", F.monotonically_increasing_id()), "queries")
    out = StructType.fromDDL(f"q {query_type}, k {key_type}, cosine double")
    pairs = _blocked(rows, "k", key_type).crossJoin(asked)
    found = pairs.mapInArrow(_compare(k, least, out), out)
    w = Window.partitionBy("q").orderBy(F.col("cosine").desc(), "k")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query), F.col("k").alias(key), "cosine", "rank")


def _blocked(rows: DataFrame, name: str, key_type: str) -> DataFrame:
    """Rows of keys and vectors in blocks: the keys, and their vectors of length 1 end to end."""
    schema = StructType.fromDDL(f"{name}s array<{key_type}>, {name}v binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, VECTOR_BLOCK):
                part = batch.slice(at, VECTOR_BLOCK)
                m = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], arrow.field(0).type), pa.array([m.tobytes()], pa.binary())], schema=arrow)

    return rows.mapInArrow(run, schema)


def _blocks(rows: Iterator, size: int) -> Iterator[list]:
    while block := list(itertools.islice(rows, size)):
        yield block


def _compare(k: int, least: float, schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[list, np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for keys, mine, asked, theirs, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(mine).reshape(len(keys), -1), np.frombuffer(theirs).reshape(len(asked), -1)
                cos = a @ b.T
                cut = max(0, len(cos) - k)
                # all that tie with the k-th stay, so that ties are settled by key over all tasks
                at, which = np.nonzero((cos >= np.partition(cos, cut, axis=0)[cut]) & (cos >= least))
                new = which, np.array(keys, object)[at], cos[at, which]
                held = best.get(block)
                best[block] = (asked, *_kept(*(np.concatenate(x) for x in zip(held[1:], new, strict=True)), len(asked), k)) if held else (asked, *new)
        for asked, which, keys, cos in best.values():
            yield pa.RecordBatch.from_arrays([pa.array([asked[i] for i in which], arrow.field(0).type), pa.array(keys.tolist(), arrow.field(1).type), pa.array(cos)], schema=arrow)

    return run


def _kept(which: np.ndarray, keys: np.ndarray, cos: np.ndarray, queries: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the ``k`` greatest and all that tie with the last of them."""
    order = np.lexsort((-cos, which))
    which, keys, cos = which[order], keys[order], cos[order]
    counts = np.bincount(which, minlength=queries)
    first = np.cumsum(counts) - counts
    last = np.minimum(first + k, first + counts) - 1
    keep = cos >= cos[np.maximum(last, 0)][which]
    return which[keep], keys[keep], cos[keep]


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1.0)
