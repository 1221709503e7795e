"""Word lists and JSON documents from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.schema import entries, null


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a file with a key a line; blank lines are left out, and carriage returns at their ends."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("word")).where("word <> ''")
    return entries(lines, F.col("word"), null())


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, json) of files with a document a line; ``doc_id`` is a hash of it."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.md5("value").alias("doc_id"), F.col("value").alias("json"))


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, json) of files that are a document each; ``doc_id`` is the path."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("json"))
