"""A benchmark asked question by question, its runs scored and summed up in Spark."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..control.pipeline import Pipeline, shown
from ..plans.algebra import Compiler
from ..runtime import write_text
from ..sources.store import QuadStore
from . import metrics

RUNS = "id string, arm string, status string, shape string, latency_ms double, stages map<string,double>, got array<string>, gold array<string>, tags array<string>, expect_unanswered boolean"


def gold_answers(store: QuadStore, item: dict[str, Any], prefixes: dict[str, str]) -> list[str] | None:
    """The stated answers, else those of the gold query over the union of all graphs."""
    if item["gold_answers"] is not None:
        return item["gold_answers"]
    if not item["gold_sparql"]:
        return None
    c = Compiler(store, prefixes)
    if item["gold_sparql"].upper().lstrip().startswith("ASK") or "\nASK" in item["gold_sparql"].upper():
        return [shown(c.ask(item["gold_sparql"]))]
    return [str(r[0]) for r in c.select(item["gold_sparql"]).collect()]


def evaluate(spark: SparkSession, items: list[dict[str, Any]], arms: dict[str, Pipeline], prefixes: dict[str, str], traces: str | None = None) -> DataFrame:
    """One row per item and arm, with ``correct`` and ``f1``. A question that fails ends in an error row.

    Questions are asked one after another, as a person would; each is a query over all the data. ``traces``: a file for
    a line of JSON per question with what happened.
    """
    rows = []
    for arm, p in arms.items():
        for item in items:
            gold = gold_answers(p.store, item, prefixes)
            got = p.ask(item["question"])
            if traces:
                write_text(traces, json.dumps({"id": item["id"], "arm": arm, "status": got.status, "trace": json.loads(got.trace.json())}, ensure_ascii=False) + "\n", append=True)
            values = [shown(v) if isinstance(v, bool) else str(v) for v in got.values]
            rows.append((item["id"], arm, got.status, got.plan.shape if got.plan else None, 1000 * sum(got.trace.stages.values()), {k: 1000 * v for k, v in got.trace.stages.items()}, values, gold, item["tags"], item["expect_unanswered"] or gold is None))
    runs = spark.createDataFrame(rows, RUNS)
    silent = ~F.col("status").isin("answered", "no_data", "fallback")
    right = F.when(F.col("expect_unanswered"), silent).otherwise(metrics.exact_match(F.col("got"), F.col("gold")))
    return runs.withColumns({"correct": right, "f1": F.when(F.col("expect_unanswered"), silent.cast("double")).otherwise(metrics.f1(F.col("got"), F.col("gold")))})


def report(runs: DataFrame, out: str | Path) -> str:
    """Results as JSON, a table in Markdown beside them; returns the table."""
    runs = runs.cache()
    Path(out).mkdir(parents=True, exist_ok=True)
    (Path(out) / "results.json").write_text(json.dumps([json.loads(r) for r in runs.toJSON().collect()], indent=1))
    summary = metrics.summarize(runs, ["arm"]).orderBy("arm").collect()
    names = summary[0].asDict().keys() if summary else []
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(shown(v) if v is not None else "" for v in r) + " |" for r in summary)]
    (Path(out) / "report.md").write_text("\n".join(lines) + "\n")
    return "\n".join(lines)


def compare(paths: list[str]) -> str:
    """Results side by side: runs, accuracy, mean F1, and the share of each status."""
    statuses = ("answered", "no_data", "fallback", "unanswered", "error")
    rows = []
    for p in paths:
        runs = json.loads((Path(p) / "results.json").read_text())
        mean = lambda f, runs=runs: f"{sum(map(f, runs)) / max(1, len(runs)):.3f}"
        rows.append(" | ".join([f"| {p}", str(len(runs)), mean(lambda r: bool(r.get("correct"))), mean(lambda r: r.get("f1") or 0.0), *(mean(lambda r, s=s: r["status"] == s) for s in statuses)]) + " |")
    return "\n".join(["| results | runs | accuracy | f1 | " + " | ".join(statuses) + " |", "|---|---|---|---|" + "---|" * len(statuses), *rows])
