import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from triplane.llm import canonical
from triplane.llm.canonical import closest, name_form, near_pairs, reference_names, similar, tokens_of


def jaccard(a, b):
    x, y = tokens_of(a), tokens_of(b)
    return len(x & y) / len(x | y)


def words(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé日", k=rng.randint(1, 6)))
    return sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(n)})


def wanted(left, right, near):
    return {(a, b): jaccard(a, b) for a, b in itertools.product(left, right) if jaccard(a, b) >= near - 1e-9}


@pytest.mark.parametrize(("near", "small"), [(0.3, True), (0.4, False), (0.4, True), (0.8, False)])
def test_no_pair_is_lost(spark, monkeypatch, near, small):
    if not small:
        monkeypatch.setattr(canonical, "NAMES_A_SHARD", 40)
        monkeypatch.setattr(canonical, "VALUES_A_BLOCK", 20)
    left = [*words(int(near * 10), 150), "日本", "ааа", "𝔘𝔫𝔦"]
    right = sorted({*words(7, 120), left[0], left[7], "日本 語", "ооо", "𝔘𝔫𝔦 x"})
    make = lambda ws: spark.createDataFrame([(w,) for w in ws], "form string").withColumn("x", F.lit("clash"))
    got = {(a, b): j for a, b, j in rows(similar(make(left), make(right), near), "form", "other", "jaccard")}
    assert got == pytest.approx(wanted(left, right, near)) and similar(make(left), make(right), near).count() == len(got)
    assert ("ааа", "ооо") not in got


@pytest.mark.parametrize("shared", [1, 2, 3, 5])
@pytest.mark.parametrize("near", [0.25, 0.4, 0.7, 1.0])
def test_kernel_in_small_parts(monkeypatch, near, shared):
    monkeypatch.setattr(canonical, "POSTINGS_AT_ONCE", 50)
    left, right = [*words(3, 90), "x" * 5000, "q"], [*words(4, 80), "q", "x" * 30]
    rarity = collections.Counter(ord(t[0]) << 32 | ord(t[1]) for f in right for t in tokens_of(f))
    x, y, j, compared = near_pairs(left, right, rarity, near, shared)
    got = {(left[a], right[b]): s for a, b, s in zip(x.tolist(), y.tolist(), j.tolist(), strict=True)}
    assert got == pytest.approx(wanted(left, right, near)) and len(x) == len(got) <= compared
    assert [len(c) for c in near_pairs(left, [], {}, near, shared)[:3]] == [0, 0, 0] == [len(c) for c in near_pairs([], right, rarity, near, shared)[:3]]


def test_closest(spark):
    entries = spark.createDataFrame(
        [("u1", "North Yard", ["The Yard"], 5), ("u2", "Skerry Motors", [], 2), ("u3", "Möwe 2.5 Diesel", None, 1), ("u4", "Skerry", [None, ""], 9), ("u5", "skerry", [], 9), ("u6", None, [], 1), (None, "Lost", [], 1), ("u7", "Holm", [], None), ("u1", "North Yard", ["The Yard"], 5)],
        "iri string, label string, labels array<string>, popularity long",
    )
    names = reference_names(entries, "iri", [F.array("label"), F.col("labels")], "popularity")
    texts = ["north yard", "the NORTH  yard, please", "Motors, Skerry", "SkerryMotors", "Skery Motors.", "Mowe 2.5 Dieesl", "skerry", "Holm (2)", "nothing like it", "", "?!", "N0rth Yard", None, "x" * 20_000]
    df = spark.createDataFrame([(t,) for t in [*texts, *texts]], "text string").withColumn("key", F.lit("clash"))
    got = dict(rows(closest(df, "text", names), "text", "key"))
    assert got == {
        "north yard": "u1", "the NORTH  yard, please": "u1", "Motors, Skerry": "u2", "SkerryMotors": "u2", "Skery Motors.": "u2", "Mowe 2.5 Dieesl": "u3", "skerry": "u4", "Holm (2)": "u7",
        "nothing like it": None, "": None, "?!": None, "N0rth Yard": "u1", "x" * 20_000: None}
    assert rows(closest(df, "text", names.limit(0)), "key") == [(None,)] * 13
    assert rows(closest(df.limit(0), "text", names)) == []


def test_forms():
    assert name_form("  The Älan's   Garage!! ") == "the alans garage" and name_form(None) is None and name_form("?!") == ""
    assert name_form("It's OK_1") == name_form("It’s ok 1") == "its ok 1"
    assert tokens_of("ab") == {" a", "ab", "b "}
