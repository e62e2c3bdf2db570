import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from triplane.llm import sharedspans
from triplane.llm.sharedspans import compact_windows, shared_share, shared_spans, sliding_least, token_hashes

L = 150


def brute(docs, length=L):
    where = {}
    for i, t in docs.items():
        for a in range(len(t or "") - length + 1):
            where.setdefault(t[a : a + length], set()).add(i)
    out = []
    for i, t in docs.items():
        span = None
        for a in range(len(t or "") - length + 1):
            if len(where[t[a : a + length]]) > 1:
                if span and a <= span[1]:
                    span[1] = a + length
                else:
                    span = [a, a + length]
                    out.append((i, span))
    return sorted((i, a, b) for i, (a, b) in out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéß𝔘 ", k=rng.randint(1, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(rng.randint(20, 90)) for _ in range(5)]
    docs = {}
    for i in range(60):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts += [s[a : a + rng.randint(100, 400)], text(rng.randint(0, 20))]
        docs[i] = " ".join(parts)
    docs |= {100: "", 101: None, 102: "x" * 400, 103: "x" * 149, 104: docs[3], 105: docs[3], 106: shared[0] * 3, 107: "ab" * 300, 108: "ab" * 100, 109: "x" * 151}
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("doc", F.lit("clash")).withColumn("span_start", F.lit(0)).repartition(4)
    got = rows(shared_spans(df, "doc_id", "text", L))
    assert sorted(got) == brute(docs)
    share = {r["doc_id"]: r for r in shared_share(df, spark.createDataFrame(got, "doc_id long, span_start long, span_end long"), "doc_id", "text").collect()}
    assert share[101]["n_chars"] == 0 and share[101]["shared_fraction"] == 0.0 and share[104]["shared_fraction"] == 1.0 and len(share) == len(docs)


def test_texts_longer_than_a_part(spark, monkeypatch):
    docs = corpus(9)
    long = {i: t for i, t in docs.items() if t}
    big = {1: " ".join(long.values()), 2: " ".join(reversed(long.values())), 3: docs[5]}
    monkeypatch.setattr(sharedspans, "CHARS_AT_ONCE", 700)
    df = spark.createDataFrame(list(big.items()), "doc_id long, text string")
    windows = sharedspans.windows_of(df, "doc_id", "text", L)
    assert sum(r["starts"] for r in windows.collect()) == sum(len(t) - L + 1 for t in big.values())
    assert sorted(rows(shared_spans(df, "doc_id", "text", L))) == brute(big)


@pytest.mark.parametrize("length", [1, 2, 7, 20, 32, 63, 64, 300])
def test_other_lengths(spark, length):
    docs = {i: t for i, t in corpus(5).items() if i % 4 == 0 or i > 99}
    df = spark.createDataFrame([(i, t and t[:500]) for i, t in docs.items()], "doc_id long, text string")
    assert sorted(rows(shared_spans(df, "doc_id", "text", length))) == brute({i: t and t[:500] for i, t in docs.items()}, length)
    with pytest.raises(ValueError):
        shared_spans(df, "doc_id", "text", 0)


def test_empty(spark):
    assert rows(shared_spans(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", L)) == []


def test_windows_are_the_least_tokens():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 50, 500).astype(np.uint64)
    assert all(sliding_least(v, w).tolist() == [v[i : i + w].min() for i in range(500 - w + 1)] for w in (1, 2, 7, 64, 500))
    chars = rng.integers(97, 100, 2000).astype(np.uint32)
    h = token_hashes(chars, 64)
    seen = {}
    for i, x in enumerate(h.tolist()):
        assert seen.setdefault(x, chars[i : i + 64].tobytes()) == chars[i : i + 64].tobytes()
    first, count, token, anchor = compact_windows(chars, np.zeros(2000, int), L)
    assert (anchor == h[token]).all() and (first <= token).all() and (token + 64 <= first + L).all()
    assert count.sum() == 2000 - L + 1 and (first[1:] == first[:-1] + count[:-1]).all()


def test_a_passage_in_a_third_of_all_texts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    hot = " ".join(word() for _ in range(60))
    docs = {i: " ".join(word() for _ in range(20)) + (hot if i % 3 == 0 else "") + " ".join(word() for _ in range(20)) for i in range(900)}
    got = rows(shared_spans(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), "doc_id", "text", L))
    assert sorted(got) == brute(docs) and len(got) == 300
