"""Point queries: lookups, membership, counts and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.bits import bits_needed
from keyloom.schema import VALUE

FORMAT = (1, 0)


def get(entries: DataFrame, key: str | bytes) -> DataFrame:
    """The entry of one key, by a predicate that Parquet prunes with."""
    return entries.where(F.col("key") == F.lit(key))


def _on(entries: DataFrame, probes: DataFrame, on: str) -> list[tuple[str, str]]:
    """(column of the probes, column of the entries): probes with a ``dict_id`` are looked up in that dictionary alone."""
    return [(on, "key")] + ([("dict_id", "dict_id")] if "dict_id" in probes.columns and "dict_id" in entries.columns else [])


def _joined(entries: DataFrame, probes: DataFrame, on: str, values: tuple[str, ...] | list[str]) -> DataFrame:
    pairs = _on(entries, probes, on)
    side = entries.select(*[F.col(e).alias(f"__{e}") for _, e in pairs], *values)
    same = [probes[p].cast("string") == side[f"__{e}"].cast("string") if e == "dict_id" else probes[p] == side[f"__{e}"] for p, e in pairs]
    joined = probes.join(side, same, "left")
    return joined.select(*[probes[c] for c in probes.columns], F.col("__key").isNotNull().alias("found"), *[side[v] for v in values])


def lookup(entries: DataFrame, probes: DataFrame, on: str = "key") -> DataFrame:
    """Every probe with ``found`` and the value of its key.

    Probes with a ``dict_id`` are looked up in that dictionary; without one, a probe gives a row for each dictionary that
    holds it. A null value that is present is found; a null probe isn't. Catalyst broadcasts the smaller side if it is
    small, else both are shuffled by the key.
    """
    return _joined(entries, probes, on, VALUE)


def contains(entries: DataFrame, probes: DataFrame, on: str = "key") -> DataFrame:
    """Every probe with ``found``, as in :func:`lookup`; values aren't read."""
    return _joined(entries, probes, on, [])


def _side(entries: DataFrame, probes: DataFrame, on: str) -> tuple[DataFrame, list[str]]:
    pairs = _on(entries, probes, on)
    kind = dict(probes.dtypes)
    return entries.select(*[(F.col(e).cast(kind[p]) if e == "dict_id" else F.col(e)).alias(p) for p, e in pairs]), [p for p, _ in pairs]


def present(entries: DataFrame, probes: DataFrame, on: str = "key") -> DataFrame:
    """The probes that are keys, of their ``dict_id`` if they have one."""
    side, names = _side(entries, probes, on)
    return probes.join(side, names, "left_semi")


def missing(entries: DataFrame, probes: DataFrame, on: str = "key") -> DataFrame:
    """The probes that aren't keys, of their ``dict_id`` if they have one."""
    side, names = _side(entries, probes, on)
    return probes.join(side, names, "left_anti")


def alphabet(entries: DataFrame) -> DataFrame:
    """(dict_id, byte): the distinct bytes of the keys.

    Keys give a set of their own bytes each, so little is shuffled.
    """
    raw = F.col("key").cast("binary")
    own = F.when(F.octet_length("key") > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.octet_length("key")), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int"))))
    return entries.select("dict_id", F.explode(own).alias("byte")).distinct()


def info(entries: DataFrame, total_bytes: Column | None = None) -> DataFrame:
    """One row a dictionary: keys, key bytes, whether it has values, its alphabet and bits a symbol, and fixed metadata."""
    counted = entries.groupBy("dict_id").agg(
        F.count(F.lit(1)).alias("num_keys"),
        F.sum(F.octet_length("key")).alias("key_bytes"),
        F.bool_or(F.col("tag") != 0).alias("has_values"),
    )
    symbols = alphabet(entries).groupBy("dict_id").agg(F.count(F.lit(1)).alias("symbols"))
    out = counted.join(symbols, "dict_id", "left").withColumn("symbols", F.coalesce("symbols", F.lit(0)))
    return out.select(
        "dict_id",
        "num_keys",
        "key_bytes",
        "has_values",
        "symbols",
        bits_needed(F.col("symbols")).alias("bits_per_symbol"),
        F.lit(FORMAT[0]).alias("version_major"),
        F.lit(FORMAT[1]).alias("version_minor"),
        F.lit("bit").alias("trie_mode"),
        F.lit("byte").alias("value_mode"),
        F.lit("crc32").alias("checksum"),
        F.lit(False).alias("has_suffix_table"),
        F.lit(False).alias("compact"),
        (F.lit(None).cast("bigint") if total_bytes is None else total_bytes).alias("total_bytes"),
    )
