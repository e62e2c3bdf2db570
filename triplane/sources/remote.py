"""Graphs behind a SPARQL endpoint: queried over HTTP, and copied in batches that survive a bad key."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quads import parse_lines, typed
from .store import QuadStore, Rel
from .turtle import XSD

#: Takes a URL, form fields, an Accept header and a timeout; gives status and body. Replaced in tests.
Transport = Callable[[str, dict[str, str], str, float], tuple[int, str]]
#: Statuses by which an endpoint says it ran out of time, and those worth another try.
TIMEOUTS, TRY_AGAIN = (408, 504), (429, 500, 502, 503)


class RemoteTimeout(RuntimeError):
    """The endpoint took too long."""


def http_post(url: str, form: dict[str, str], accept: str, timeout: float) -> tuple[int, str]:
    request = urllib.request.Request(url, urllib.parse.urlencode(form).encode(), {"Accept": accept})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.status, reply.read().decode()
    except urllib.error.HTTPError as wrong:
        return wrong.code, wrong.read().decode(errors="replace")
    except TimeoutError as slow:
        raise RemoteTimeout(str(slow)) from slow


class Endpoint:
    """A SPARQL-protocol endpoint."""

    def __init__(self, url: str, post: Transport = http_post, timeout: float = 20.0, tries: int = 3, wait: float = 1.0) -> None:
        self.url, self.post, self.timeout, self.tries, self.wait = url, post, timeout, tries, wait

    def _send(self, query: str, accept: str) -> str:
        for attempt in range(self.tries):
            status, body = self.post(self.url, {"query": query}, accept, self.timeout)
            if status in TIMEOUTS or status >= 400 and "timeout" in body.lower():
                raise RemoteTimeout(body[:200])
            if status < 400:
                return body
            if status not in TRY_AGAIN or attempt == self.tries - 1:
                raise RuntimeError(f"{status}: {body[:200]}")
            time.sleep(self.wait * 2**attempt)
        raise RuntimeError("no try allowed")

    def select(self, query: str) -> list[dict[str, Any]]:
        d = json.loads(self._send(query, "application/sparql-results+json"))
        return [{v: native(b[v]) if v in b else None for v in d["head"]["vars"]} for b in d["results"]["bindings"]]

    def ask(self, query: str) -> bool:
        return bool(json.loads(self._send(query, "application/sparql-results+json"))["boolean"])

    def construct(self, query: str) -> str:
        """N-Triples."""
        return self._send(query, "application/n-triples")

    def select_df(self, spark: SparkSession, query: str, schema: str) -> DataFrame:
        names = [f.split()[0] for f in schema.split(",")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in self.select(query)], schema)


class EndpointStore:
    """An endpoint with the face of a store, so that plans and queries compile over it.

    Each pattern is asked for with its constants in place, and its statements are read as lines; what a pattern matches
    must fit the driver. Joins, filters and aggregates run in Spark.
    """

    def __init__(self, spark: SparkSession, endpoint: Endpoint) -> None:
        self.spark, self.endpoint = spark, endpoint

    def graphs(self) -> list[str]:
        return sorted(r["g"] for r in self.endpoint.select("SELECT DISTINCT ?g WHERE { GRAPH ?g { ?s ?p ?o } }"))

    def holders(self, graph: str | None, predicate: str | None) -> int:  # noqa: ARG002
        return 1

    def star(self, graph: str | None, predicates: list[str], types: list[str], template: str | None = None) -> None:  # noqa: ARG002
        return None

    def scan(self, graph: str | None, predicate: str | None, types: dict[str, str] | None = None, merge: bool = False) -> Rel:
        pattern = f"?s {f'<{predicate}>' if predicate else '?p'} ?o"
        names = [graph] if graph is not None else [None] if merge else self.graphs()
        parts = []
        for name in names:
            where = pattern if name is None else f"GRAPH <{name}> {{ {pattern} }}"
            lines = self.endpoint.construct(f"CONSTRUCT {{ {pattern} }} WHERE {{ {where} }}").splitlines()
            parts.append(typed(parse_lines(self.spark.createDataFrame([(x,) for x in lines], "value string"), name)))
        quads = reduce(DataFrame.unionByName, parts) if parts else typed(parse_lines(self.spark.createDataFrame([], "value string")))
        return QuadStore(quads).scan(graph, predicate, types, merge)


def native(binding: dict[str, str]) -> Any:
    """A JSON result term as a value; literals that aren't of their datatype stay text."""
    text, kind = binding["value"], binding.get("datatype", "").removeprefix(XSD)
    try:
        if kind in ("integer", "int", "long", "gYear"):
            return int(text)
        if kind in ("decimal", "double", "float"):
            return float(text)
    except ValueError:
        return text
    return text in ("true", "1") if kind == "boolean" else f"_:{text}" if binding["type"] == "bnode" else text


def fetch(keys: DataFrame, key: str, query: Callable[[list[str]], str], endpoint: Endpoint, graph: str, batch: int = 200) -> tuple[DataFrame, DataFrame]:
    """Statements about every key, as quads, and the keys that could not be had.

    Tasks ask for ``batch`` keys at once. A batch that fails is halved until the keys that fail alone are known; the
    rest of it isn't lost.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            names = pdf[key].tolist()
            for at in range(0, len(names), batch):
                lines, bad = construct_split(names[at : at + batch], query, endpoint)
                yield pd.DataFrame({"value": [*lines, *bad], "bad": [False] * len(lines) + [True] * len(bad)})

    from ..runtime import materialize

    got = materialize(keys.select(key).where(F.col(key).isNotNull()).distinct().mapInPandas(run, "value string, bad boolean"), "fetched")
    return typed(parse_lines(got.where("NOT bad"), graph)), got.where("bad").select(F.col("value").alias(key))


def construct_split(names: list[str], query: Callable[[list[str]], str], endpoint: Endpoint) -> tuple[list[str], list[str]]:
    """Lines about the names, and the names that fail alone."""
    if not names:
        return [], []
    try:
        return endpoint.construct(query(names)).splitlines(), []
    except RuntimeError:
        if len(names) == 1:
            return [], names
        half = len(names) // 2
        a, b = construct_split(names[:half], query, endpoint), construct_split(names[half:], query, endpoint)
        return a[0] + b[0], a[1] + b[1]


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made unless it is there already, so that a broken run goes on where it stopped."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


