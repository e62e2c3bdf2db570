"""Every query of the core against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from triplane.suite import catalog, graph, linking, quality, schema, text

DATA = "/root/testdata/sf0.001"
SUITE = {k: (f, m.SQL.get(k)) for m in (graph, text, catalog, linking, quality, schema) for k, f in m.QUERIES.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", SUITE)
def test_query(spark, sql, name):
    f, q = SUITE[name]
    df = f(spark, DATA)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if q is None:
        return
    cur = sql.execute(q)
    names = [c[0] for c in cur.description]
    want = sorted(repr([plain(v) for _, v in sorted(zip(names, r, strict=True))]) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(names) and got == want
