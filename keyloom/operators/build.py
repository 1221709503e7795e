"""Build dictionaries: add, deduplicate, change, write and read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.schema import VALUE


def add(entries: DataFrame, *more: DataFrame) -> DataFrame:
    """The entries of all tables; later insertions have the larger ``seq``."""
    for df in more:
        entries = entries.unionByName(df)
    return entries


def build(entries: DataFrame) -> DataFrame:
    """One entry a (dict_id, key): of several, the one of the largest ``seq``, ties by value.

    One shuffle on the key, with a combination before it.
    """
    last = entries.groupBy("dict_id", "key").agg(F.max(F.struct("seq", *VALUE)).alias("__v"))
    return last.select("dict_id", "key", "__v.*")


def upsert(base: DataFrame, delta: DataFrame) -> DataFrame:
    """``base`` with the entries of ``delta`` added or replaced, whatever their ``seq``."""
    first = base.select("dict_id", "key", F.struct(F.lit(0).alias("layer"), "seq", *VALUE).alias("__v"))
    later = delta.select("dict_id", "key", F.struct(F.lit(1).alias("layer"), "seq", *VALUE).alias("__v"))
    last = first.unionByName(later).groupBy("dict_id", "key").agg(F.max("__v").alias("__v"))
    return last.select("dict_id", "key", *[F.col(f"__v.{c}") for c in ("seq", *VALUE)])


def delete(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """``entries`` without the keys of a table (key), or (dict_id, key)."""
    on = ["dict_id", "key"] if "dict_id" in keys.columns else ["key"]
    return entries.join(keys.select(*on), on, "left_anti")


def replay(base: DataFrame, journal: DataFrame) -> DataFrame:
    """``base`` after a journal of entries with ``deleted``, of which the newest of a key holds."""
    cells = ("seq", *VALUE, "deleted")
    old = base.withColumn("deleted", F.lit(False)).select("dict_id", "key", F.struct(F.lit(0).alias("layer"), *cells).alias("__v"))
    new = journal.select("dict_id", "key", F.struct(F.lit(1).alias("layer"), *cells).alias("__v"))
    last = old.unionByName(new).groupBy("dict_id", "key").agg(F.max("__v").alias("__v")).where("not __v.deleted")
    return last.select("dict_id", "key", *[F.col(f"__v.{c}") for c in ("seq", *VALUE)])


def write(entries: DataFrame, path: str, files: int | None = None, bloom: bool = True) -> None:
    """Write a dictionary as Parquet, in key order.

    Files have ranges of keys, and rows are sorted in them, so point, prefix and range reads skip row groups by their
    statistics; a bloom filter on the key answers misses.
    """
    order = ["dict_id", "key"]
    spread = entries.repartitionByRange(files, *order) if files else entries.repartitionByRange(*order)
    writer = spread.sortWithinPartitions(*order).write.option("compression", "zstd")
    if bloom:
        writer = writer.option("parquet.bloom.filter.enabled#key", "true")
    writer.parquet(path)


def with_metadata(entries: DataFrame, metadata: dict) -> DataFrame:
    """``entries`` with metadata of a caller's own (names to numbers, texts, or lists of them), which files keep."""
    return entries.withMetadata("key", metadata)


def metadata(entries: DataFrame) -> dict:
    """What :func:`with_metadata` gave these entries, also after they were written and read; {} if nothing."""
    return dict(entries.schema["key"].metadata or {})


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def from_map(df: DataFrame, column: str, val, dict_id=None) -> DataFrame:
    """Entries of a map column, one a key; ``val`` makes a tagged value of a payload column."""
    from keyloom.schema import entries

    named = F.lit("") if dict_id is None else dict_id
    pairs = df.select(named.alias("__id"), F.posexplode(column).alias("__seq", "__key", "__payload"))
    return entries(pairs, F.col("__key"), val(F.col("__payload")), F.col("__seq"), F.col("__id"))


def to_map(entries: DataFrame, val) -> DataFrame:
    """(dict_id, map): the inverse of :func:`from_map` for built entries; ``val`` is the column of the map's values."""
    return entries.groupBy("dict_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("key"), val.alias("value"))))).alias("map"))
