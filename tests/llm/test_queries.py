"""The queries on the smallest tables: against SQL, and against plain versions where SQL can't say them."""

import math
import os

import duckdb
import pytest

from conftest import rows
from triplane.llm.queries import QUERIES, SQL
from triplane.llm.sparqlform import record_form

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    return "NaN" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert len(got) == len(set(got))
    if name in SQL:
        cur = sql.execute(SQL[name])
        names = [c[0] for c in cur.description]
        assert got == sorted(repr([plain(v) for _, v in sorted(zip(names, r, strict=True))]) for r in cur.fetchall())


def test_p6_by_dictionary(spark, sql):
    items = {}
    for i, q, s in sql.execute("SELECT row_id, question, gold_sparql FROM benchmark_item").fetchall():
        items.setdefault(record_form(q, s), []).append(i)
    assert sorted(rows(QUERIES["p6_found"](spark, DATA))) == sorted((min(v), i) for v in items.values() for i in v if i != min(v))


def test_p9_by_dictionary(spark, sql):
    from test_sharedspans import brute

    docs = dict(sql.execute("SELECT doc_id, text FROM documents").fetchall())
    assert sorted(rows(QUERIES["p9_found"](spark, DATA))) == brute(docs)
