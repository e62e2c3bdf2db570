import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from triplane.operators.retrieval import bm25_top, nearest_vectors, trigram_matches


def test_bm25_is_the_formula(spark):
    docs = {1: "a b b c", 2: "a a d", 3: "", 4: "e f", 5: None}
    df = spark.createDataFrame(list(docs.items()), "id int, x string")
    words = F.filter(F.split("x", " "), lambda w: w != "")
    asked = spark.createDataFrame([(1, "a b a"), (2, "zzz"), (3, "e")], "q int, x string")
    got = {(r["q"], r["id"]): r["score"] for r in bm25_top(df, "id", words, asked, "q", words, 3).collect()}
    bags = {i: Counter((x or "").split()) for i, x in docs.items()}
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    dfs = Counter(w for b in bags.values() for w in b)

    def score(q, i):
        return sum(math.log(1 + (5 - dfs[w] + 0.5) / (dfs[w] + 0.5)) * bags[i][w] * 2.2 / (bags[i][w] + 1.2 * (0.25 + 0.75 * sum(bags[i].values()) / mean)) for w in set(q.split()) if bags[i][w])

    assert got == pytest.approx({(1, 1): score("a b a", 1), (1, 2): score("a b a", 2), (3, 4): score("e", 4)})


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(5)
    m = rng.integers(-2, 3, (60, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "id long, v array<double>").repartition(5)
    asked = df.where("id % 20 = 0").select(F.col("id").alias("q"), "v")
    got = rows(nearest_vectors(df, "id", "v", asked, "q", 5), "q", "rank", "id")
    n = np.linalg.norm(m, axis=1)
    unit = m / np.where(n > 0, n, 1)[:, None]
    for q in (0, 20, 40):
        cos = unit @ unit[q]
        best = sorted(range(60), key=lambda i: (-round(cos[i], 12), i))[:5]
        mine = [r[2] for r in sorted(r for r in got if r[0] == q)]
        assert np.allclose(sorted(cos[mine]), sorted(cos[best]))
    assert nearest_vectors(df, "id", "v", asked.limit(0), "q", 5).count() == 0


def test_trigrams(spark):
    names = spark.createDataFrame([("North Yard",), ("South Yard",), (None,), ("Nörth Yard",), ("",)], "n string")
    asked = spark.createDataFrame([("nort yard",), ("xyz",), (None,)], "q string")
    assert [(r["query"], r["name"]) for r in trigram_matches(asked, "q", names, "n", least=0.6).collect()] == [("nort yard", "north yard")]
