"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import compression, decontaminate, linetemplates, minhash, mixing, sharding, substrings, toxicity, urls, warc
from keyloom.plans.lineage import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents, with their scores."""
    return toxicity.toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line whose template recurs across documents."""
    return linetemplates.recurring_lines(_table(spark, sf_dir, "documents"))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose compression ratios lie within their bands."""
    return compression.kept(_table(spark, sf_dir, "documents"))


def op4_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every interval of tokens that repeats, in every document, and whether it is to be removed."""
    return substrings.repeats(_table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of a group of near-duplicates, with the one that its group keeps."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record recovered from archives of all pages, and every gap.

    One page in 16 is spoilt on purpose, by a hash of its id: the tables hold no damaged archive.
    """
    pages = _table(spark, sf_dir, "pages")
    kind = F.pmod(F.xxhash64("page_id"), F.lit(64))
    archives = cut(warc.pack(pages, F.when(kind < 2, warc.FLIP).when(kind < 3, warc.TRUNCATE).when(kind < 4, warc.GARBAGE)), "archives")
    return warc.salvaged(cut(warc.measured(warc.from_table(archives)), "records"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item that it contains."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, the score of its URL, and whether it is rejected.

    The tables label no URL, so the examples are all pages, labelled by words in their hosts.
    """
    pages = _table(spark, sf_dir, "pages")
    return urls.url_filter(pages, urls.word_examples(pages))


def op9_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with its slot and shard."""
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate says."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_line_templates, op3_compression_bands, op4_repeated_substrings, op5_near_duplicates, op6_warc_salvage, op7_decontamination, op8_url_language_models, op9_shard_placement, op10_source_mixing)
}


def oracle_sql() -> dict[str, str]:
    return {"op9_shard_placement": sharding.oracle_sql(), "op10_source_mixing": mixing.ORACLE_SQL}
