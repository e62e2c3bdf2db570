"""Catalog statistics over the whole store."""

import os

import pytest

from conftest import rows
from triplane.sources import testgraph as tg
from triplane.sources.store import TYPE
from triplane.suite.catalog import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_every_class_and_predicate_is_counted(spark):
    assert {r[0] for r in QUERIES["stats_class_counts_all"](spark, DATA).select("class").collect()} == {tg.ONTO + v[1] for v in tg.TABLES.values()}
    names = {tg.ONTO + x.split(": ")[1].split(" > ")[0] for v in tg.TABLES.values() for x in v[3].split(", ")}
    assert {r[0] for r in QUERIES["stats_predicate_counts_all"](spark, DATA).select("p").collect()} == names


def test_samples_of_every_predicate(spark):
    seen = {}
    for p, o in tg.store(spark, DATA).quads().select("p", "o").distinct().collect():
        if p != TYPE:
            seen.setdefault(p, set()).add(o)
    want = [(p, i, o) for p, v in seen.items() for i, o in enumerate(sorted(v)[:3])]
    assert rows(QUERIES["sample_objects_all"](spark, DATA)) == rows(spark.createDataFrame(want, "p string, at int, sample string"))
