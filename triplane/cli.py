"""``python -m triplane.cli build|ask|eval|compare|schema|fetch|sample``."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from .build import build_all, pipeline
from .catalog.paths import Slicer
from .config import load_config, load_env
from .evaluation.benchmarks import answerable, load_benchmark
from .evaluation.runner import compare, evaluate, report
from .runtime import write_text
from .sources.quads import to_lines
from .sources.remote import Endpoint, fetch
from .sources.sample import sample_turtle


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="triplane")
    p.add_argument("--config", default="triplane.toml")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("build").add_argument("--no-load", action="store_true")
    asking = sub.add_parser("ask")
    asking.add_argument("question")
    asking.add_argument("--arm", default="C", choices=("A", "B", "C"))
    ev = sub.add_parser("eval")
    ev.add_argument("benchmark")
    ev.add_argument("--out", default="reports")
    ev.add_argument("--arms", default="C", help="letters of A, B and C")
    ev.add_argument("--filter", action="store_true", help="only items the store can answer")
    fetching = sub.add_parser("fetch", help="copy what an endpoint says of the IRIs in a text file, one a line")
    for name in ("url", "iris", "out"):
        fetching.add_argument(name)
    fetching.add_argument("--graph", default="")
    made = sub.add_parser("sample", help="write the sample graph as Turtle files")
    made.add_argument("out")
    made.add_argument("--orders", type=int, default=120)
    made.add_argument("--seed", type=int, default=42)
    sub.add_parser("compare").add_argument("results", nargs="+")
    sub.add_parser("schema").add_argument("classes", nargs="*")
    a = p.parse_args(argv)
    if a.command == "compare":
        print(compare(a.results))
        return
    if a.command == "sample":
        for name, text in sample_turtle(a.orders, a.seed).items():
            write_text(str(Path(a.out) / f"{name}.ttl"), text)
        return
    if a.command == "fetch":
        spark = SparkSession.builder.appName("triplane").getOrCreate()
        about = lambda iris: "CONSTRUCT { ?s ?p ?o } WHERE { VALUES ?s { " + " ".join(f"<{x}>" for x in iris) + " } ?s ?p ?o }"
        got, bad = fetch(spark.read.text(a.iris).withColumnRenamed("value", "iri"), "iri", about, Endpoint(a.url), a.graph)
        to_lines(got, with_graph=bool(a.graph)).write.mode("overwrite").text(a.out)
        print(f"{got.count()} statements; {bad.count()} IRIs could not be had")
        return
    cfg = load_config(a.config)
    load_env(Path(a.config).parent / ".env")
    spark = SparkSession.builder.appName("triplane").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "build":
        _, cat, index = build_all(spark, cfg, load=not a.no_load)
        print(f"{len(cat.classes)} classes, {len(cat.properties)} properties, {index.records.count()} named nodes")
    elif a.command == "ask":
        got = pipeline(spark, cfg, a.arm).ask(a.question)
        print(got.text(), f"({got.status}, {got.confidence:.2f})")
    elif a.command == "eval":
        arms = {x: pipeline(spark, cfg, x) for x in a.arms}
        items = load_benchmark(a.benchmark)
        items = answerable(items, next(iter(arms.values())).store, cfg.prefixes) if a.filter else items
        print(report(evaluate(spark, items, arms, cfg.prefixes, str(Path(a.out) / "traces.jsonl")), a.out))
    else:
        cat = pipeline(spark, cfg).catalog
        print(Slicer(cat).slice(a.classes)[0] if a.classes else Slicer(cat).overview())


if __name__ == "__main__":
    main()
