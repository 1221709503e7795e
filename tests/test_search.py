"""Searches against brute force."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom import schema
from keyloom.operators import build, search

WORDS = ["app", "apple", "application", "apply", "approve", "ban", "banana", "band", "bank", "cherry", "date", "", "a", "world", "word"]


def keys(spark, words):
    return build.build(schema.entries(spark.createDataFrame([(w,) for w in words], "w string"), F.col("w"), schema.null()))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def names(df):
    return sorted(r.key for r in df.collect())


@pytest.mark.parametrize("text", ["app", "ban", "", "zzz", "apple"])
def test_prefix(spark, text):
    assert names(search.prefix(keys(spark, WORDS), text)) == sorted(w for w in WORDS if w.startswith(text))


def test_utf8_prefix(spark):
    assert names(search.prefix(keys(spark, ["cafe", "café", "東京", "東京都", "東北", "😀"]), "東京")) == ["東京", "東京都"]


def test_suffix_affix_infix_and_range(spark):
    k = keys(spark, WORDS)
    assert names(search.suffix(k, "y")) == ["apply", "cherry"]
    assert names(search.suffix_indexed(search.reversed_keys(k), "and")) == ["band"]
    assert names(search.affix(k, "a", "e")) == ["apple", "approve"]
    assert names(search.infix(k, "an")) == sorted(w for w in WORDS if "an" in w)
    assert names(search.between(k, "apply", "band")) == sorted(w for w in WORDS if "apply" <= w <= "band")


def test_joins_by_prefix_and_suffix(spark):
    k = keys(spark, WORDS)
    affixes = ["", "a", "app", "ban", "le", "e", "nothing"]
    got = {(r.prefix, r.key) for r in search.prefix_join(k, spark.createDataFrame([(a,) for a in affixes], "prefix string")).collect()}
    assert got == {(a, w) for a in affixes for w in WORDS if w.startswith(a)}
    got = {(r.suffix, r.key) for r in search.suffix_join(k, spark.createDataFrame([(a,) for a in affixes], "suffix string")).collect()}
    assert got == {(a, w) for a in affixes for w in WORDS if w.endswith(a)}
    assert search.prefix_join(k, spark.createDataFrame([], "prefix string")).count() == 0


@pytest.mark.parametrize("d", [0, 1, 2])
def test_fuzzy_join_is_complete(spark, d):
    queries = ["wrold", "banan", "aple", "", "ab", "café", "chery"]
    got = {(r.query, r.key, r.distance) for r in search.fuzzy_join(keys(spark, [*WORDS, "cafe"]), spark.createDataFrame([(q,) for q in queries], "query string"), d).collect()}
    assert got == {(q, w, distance(q, w)) for q in queries for w in [*WORDS, "cafe"] if distance(q, w) <= d}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("abé", max_size=5), min_size=1, max_size=12, unique=True), st.integers(0, 2))
def test_fuzzy_join_of_any_words(spark, words, d):
    k = keys(spark, words)
    got = {(r.query, r.key) for r in search.fuzzy_join(k, k.select(F.col("key").alias("query")), d).collect()}
    assert got == {(a, b) for a, b in itertools.product(words, words) if distance(a, b) <= d}


def test_fuzzy_join_compares_no_cartesian_product(spark):
    plan = search.fuzzy_join(keys(spark, WORDS), spark.createDataFrame([("a",)], "query string"), 2)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan


def test_transpositions_count_twice(spark):
    (row,) = search.fuzzy(keys(spark, ["world"]), "wrold", 2).collect()
    assert row.distance == 2
    with pytest.raises(ValueError):
        search.fuzzy_join(keys(spark, ["a"]), spark.createDataFrame([("a",)], "query string"), 3)


def test_best_breaks_ties_by_key(spark):
    q = spark.createDataFrame([("bane",)], "query string")
    got = [(r.key, r.rank) for r in search.fuzzy_best(keys(spark, WORDS), q, 2, 3).orderBy("rank").collect()]
    assert got == [("ban", 1), ("band", 2), ("bank", 3)]


def test_autocomplete_ranks_by_weight(spark):
    k = schema.entries(spark.createDataFrame([("apple", 3), ("apply", 9), ("app", 9), ("ban", 99)], "w string, v int"), F.col("w"), schema.int64(F.col("v")))
    assert [r.key for r in search.autocomplete(k, "app", 2, F.col("v_int")).orderBy("rank").collect()] == ["app", "apply"]


def test_grams_and_sounds(spark):
    k = keys(spark, WORDS)
    got = {r.key: r.similarity for r in search.gram_join(k, spark.createDataFrame([("apples",)], "query string"), 2, 0.5).collect()}
    assert got == {"apple": 0.8, "apply": 0.5}
    assert sorted(r.key for r in search.sounds_like(k, spark.createDataFrame([("aple",)], "query string")).collect()) == ["apple", "apply"]
