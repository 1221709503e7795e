"""Ordered scans, affix, range, fuzzy, ranked and approximate searches over keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edit distances beyond this make too many variants of a key.
MAX_DISTANCE = 2


def scan(entries: DataFrame) -> DataFrame:
    """All entries in the order of their keys' bytes."""
    return entries.orderBy("dict_id", "key")


def prefix(entries: DataFrame, text: str) -> DataFrame:
    """The entries whose keys start with ``text``; pushed down to Parquet as StringStartsWith."""
    return entries.where(F.col("key").startswith(text))


def suffix(entries: DataFrame, text: str) -> DataFrame:
    return entries.where(F.col("key").endswith(text))


def affix(entries: DataFrame, start: str, end: str) -> DataFrame:
    """The entries whose keys start with ``start`` and end with ``end``."""
    return entries.where(F.col("key").startswith(start) & F.col("key").endswith(end))


def infix(entries: DataFrame, text: str) -> DataFrame:
    return entries.where(F.col("key").contains(text))


def between(entries: DataFrame, low: str, high: str) -> DataFrame:
    """The entries with low <= key <= high, by bytes."""
    return entries.where(F.col("key").between(low, high))


def reversed_keys(entries: DataFrame) -> DataFrame:
    """The entries with ``reversed``, by which a table can be sorted so that suffix searches skip row groups."""
    return entries.withColumn("reversed", F.reverse("key"))


def suffix_indexed(index: DataFrame, text: str) -> DataFrame:
    return index.where(F.col("reversed").startswith(text[::-1]))


def prefix_join(entries: DataFrame, prefixes: DataFrame, lengths: list[int] | None = None) -> DataFrame:
    """(prefix, entry): every entry with every prefix of ``prefixes`` that its key starts with.

    A key is joined by its starts of those lengths that prefixes have, which is an equi-join; a join by startswith would
    compare all pairs. The distinct lengths are few and are collected, unless given.
    """
    wanted = prefixes.select("prefix").distinct()
    if lengths is None:
        lengths = sorted(r[0] for r in wanted.select(F.length("prefix")).distinct().collect() if r[0] is not None)
    if not lengths:
        return wanted.join(entries, F.lit(False))
    starts = [F.when(F.length("key") >= n, F.substring("key", 1, n)) for n in lengths]
    keyed = entries.withColumn("prefix", F.explode(F.array_compact(F.array(*starts))))
    return keyed.join(wanted, "prefix").select("prefix", *entries.columns)


def suffix_join(entries: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(suffix, entry), as :func:`prefix_join`."""
    turned = prefix_join(entries.withColumn("key", F.reverse("key")), suffixes.select(F.reverse("suffix").alias("prefix")))
    return turned.select(F.reverse("prefix").alias("suffix"), *[F.reverse("key").alias("key") if c == "key" else c for c in entries.columns])


def fuzzy(entries: DataFrame, query: str, distance: int) -> DataFrame:
    """The entries whose keys are within ``distance`` edits (Levenshtein, by characters) of ``query``, with ``distance``."""
    if distance < 0:
        raise ValueError("the distance must not be negative")
    near = F.abs(F.length("key") - len(query)) <= distance
    return entries.where(near).withColumn("distance", F.levenshtein(F.col("key"), F.lit(query), distance)).where("distance >= 0")


def variants(text: Column, distance: int) -> Column:
    """All strings that are left of ``text`` after at most ``distance`` deletions."""
    shorter = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), s.substr(i + 1, F.length(s))))).otherwise(F.array().cast("array<string>"))
    out = level = F.array(text)
    for _ in range(distance):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def fuzzy_index(entries: DataFrame, distance: int) -> DataFrame:
    """(key, variant): what :func:`fuzzy_join` looks keys up by, to be written once and passed to it as ``index``."""
    return entries.select("key").distinct().select("key", F.explode(variants(F.col("key"), distance)).alias("variant"))


def fuzzy_join(entries: DataFrame, queries: DataFrame, distance: int, index: DataFrame | None = None) -> DataFrame:
    """(query, distance, entry): every entry within ``distance`` edits of every query of ``queries``.

    Two strings within d edits share a string that either becomes by at most d deletions (FastSS); both sides are
    joined by those, which is an equi-join and complete, and the distance is then verified. With an ``index`` of
    :func:`fuzzy_index`, made for ``distance`` or more, the keys' variants are read instead of made.
    """
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"the distance must be between 0 and {MAX_DISTANCE}")
    left = queries.select("query").distinct().where("query is not null").select("query", F.explode(variants(F.col("query"), distance)).alias("__variant"))
    keys = (fuzzy_index(entries, distance) if index is None else index).withColumnRenamed("variant", "__variant")
    pairs = left.join(keys, "__variant").where(F.abs(F.length("key") - F.length("query")) <= distance).select("query", "key").distinct()
    near = pairs.withColumn("distance", F.levenshtein(F.col("query"), F.col("key"), distance)).where("distance >= 0")
    return near.join(entries, "key").select("query", "distance", *entries.columns)


def best(found: DataFrame, n: int, by: list[Column], each: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows by an order, of every group of ``each`` if it is given, with ``rank`` from 1."""
    if n < 1:
        raise ValueError("at least one row must be asked for")
    order = Window.partitionBy(*each).orderBy(*by) if each else None
    if order is None:
        found = found.orderBy(*by).limit(n)
        order = Window.orderBy(*by)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def fuzzy_best(entries: DataFrame, queries: DataFrame, distance: int, n: int) -> DataFrame:
    """The ``n`` nearest keys of each query, ties by key."""
    return best(fuzzy_join(entries, queries, distance), n, [F.col("distance"), F.col("key")], ["query"])


def autocomplete(entries: DataFrame, text: str, n: int, weight: Column) -> DataFrame:
    """The ``n`` entries of most weight whose keys start with ``text``, ties by key."""
    return best(prefix(entries, text), n, [weight.desc(), F.col("key")])


def sounds_like(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, entry): every entry with the same Soundex code as a query."""
    left = queries.select("query").distinct().withColumn("__code", F.soundex("query"))
    return left.join(entries.withColumn("__code", F.soundex("key")), "__code").select("query", *entries.columns)


def grams(text: Column, n: int) -> Column:
    """The distinct substrings of ``n`` characters; none of a shorter text."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: text.substr(i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def gram_join(entries: DataFrame, queries: DataFrame, n: int = 3, least: float = 0.5) -> DataFrame:
    """(query, similarity, key): keys that share at least ``least`` of the union of their n-grams with a query."""
    left = queries.select("query").distinct().withColumn("__l", grams(F.col("query"), n))
    right = entries.select("key").distinct().withColumn("__r", grams(F.col("key"), n))
    pairs = left.select("query", F.size("__l").alias("__nl"), F.explode("__l").alias("__g")).join(right.select("key", F.size("__r").alias("__nr"), F.explode("__r").alias("__g")), "__g")
    shared = pairs.groupBy("query", "key", "__nl", "__nr").agg(F.count(F.lit(1)).alias("__both"))
    return shared.select("query", (F.col("__both") / (F.col("__nl") + F.col("__nr") - F.col("__both"))).alias("similarity"), "key").where(F.col("similarity") >= least)
