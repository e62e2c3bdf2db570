"""Question sets: the native form, QALD and LC-QuAD, told apart by their shape."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.algebra import Compiler
from ..plans.sparql import Query, SparqlError, parse, used_iris
from ..sources.store import text_of

SCHEMA = "id string, question string, gold_sparql string, gold_answers array<string>, gold struct<module: string, class: string, shape: string, properties: array<string>, entities: array<string>>, tags array<string>, expect_unanswered boolean"


def load_benchmark(path: str | Path) -> list[dict[str, Any]]:
    """Items of a JSON file, each with the fields of :data:`SCHEMA`."""
    data = json.loads(Path(path).read_text())
    if isinstance(data, dict) and "questions" in data and any("query" in q or isinstance(q.get("question"), list) for q in data["questions"]):
        return [_qald(q) for q in data["questions"]]
    rows = data if isinstance(data, list) else data.get("items") or data.get("questions") or []
    if rows and ("sparql_wikidata" in rows[0] or "NNQT_question" in rows[0]):
        return [_lcquad(r) for r in rows]
    return [_native(r) for r in rows]


def _native(r: dict) -> dict:
    gold = r.get("gold") or {}
    answers = r.get("gold_answers")
    return {
        "id": str(r.get("id", "")), "question": r.get("question"), "gold_sparql": r.get("gold_sparql"),
        "gold_answers": None if answers is None else [str(a) for a in answers],
        "gold": {k: gold.get(k) for k in ("module", "class", "shape")} | {k: list(gold.get(k) or []) for k in ("properties", "entities")},
        "tags": list(r.get("tags") or []), "expect_unanswered": bool(r.get("expect_unanswered", False)),
    }


def _qald(q: dict) -> dict:
    texts = q.get("question")
    text = next((t["string"] for t in texts if t.get("language") == "en"), texts[0]["string"] if texts else None) if isinstance(texts, list) else texts
    answers = []
    for a in q.get("answers") or []:
        if "boolean" in a:
            answers.append(str(a["boolean"]).lower())
        for b in (a.get("results") or {}).get("bindings", []):
            answers += [v["value"] for v in b.values()]
    return _native({"id": q.get("id"), "question": text, "gold_sparql": (q.get("query") or {}).get("sparql"), "gold_answers": answers or None, "tags": ["qald"]})


def _lcquad(r: dict) -> dict:
    return _native({"id": r.get("uid"), "question": r.get("question") or r.get("NNQT_question"), "gold_sparql": r.get("sparql_wikidata"), "tags": ["lcquad", str(r.get("template") or r.get("subgraph") or "")]})


def benchmark_df(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(load_benchmark(path), SCHEMA)


def answerable(items: list[dict[str, Any]], store: Any, prefixes: dict[str, str] | None = None) -> list[dict[str, Any]]:
    """The items a store can be asked: every IRI of the gold query stands in it, and the query has an answer.

    Each kept item is tagged ``match`` where that answer is the stated one as a set, or none is stated; else ``drift``.
    All IRIs of all items are looked for in one pass over the store.
    """
    spark = store.spark
    parsed: dict[int, Query] = {}
    for i, item in enumerate(items):
        try:
            if item["gold_sparql"]:
                parsed[i] = parse(item["gold_sparql"], prefixes or {})
        except SparqlError:
            continue
    wanted = sorted({x for q in parsed.values() for x in used_iris(q) if not x.startswith("http://www.w3.org/")})
    every = store.scan(None, None)
    asked = spark.createDataFrame([(x,) for x in wanted], "iri string")
    text = lambda n: text_of(every.info[n], F.col(n))
    nodes = every.df.select(F.explode(F.array(text("s"), text("p"), text("o"))).alias("iri"))
    known = {r["iri"] for r in nodes.join(F.broadcast(asked), "iri", "left_semi").distinct().collect()}  # at most the IRIs asked for
    compiler, out = Compiler(store, prefixes or {}), []
    for i, q in parsed.items():
        if not {x for x in used_iris(q) if not x.startswith("http://www.w3.org/")} <= known:
            continue
        got = {str(compiler.ask(q)).lower()} if q.form == "ask" else {str(r[0]) for r in compiler.select(q).collect() if r[0] is not None}
        if got:
            stated = items[i]["gold_answers"]
            out.append({**items[i], "tags": [*items[i]["tags"], "match" if stated is None or {str(x) for x in stated} == got else "drift"]})
    return out
