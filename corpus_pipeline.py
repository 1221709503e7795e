"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes whole tables and whole texts. Null, empty and very long texts, null ids, repeated rows, empty tables and
extra columns are no errors; what becomes of them is said at each stage. An id that is no integer counts as null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import decontaminate, minhash, mixing, sharding, toxicity
from keyloom.plans.lineage import cut


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the lexicon induced from them and ``labels`` doesn't reject.

    Null, empty and wordless texts stay. A score that ties with the limit rejects. Repeated rows stay or go together.
    Without labels, or without toxic ones, all documents stay. Columns stay as they are, whatever their names.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and all that are in none.

    A group keeps its least (doc_id, key), null ids first; of repeated rows with a token one stays. Null, empty and
    wordless texts are in no group and all stay. Columns stay as they are, whatever their names.
    """
    return minhash.one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no item of ``benchmark``.

    Null and empty texts contain nothing and stay; null and empty items are contained nowhere, so that an empty benchmark
    keeps all documents. Containment that ties with the limit rejects. Repeated rows stay or go together. Columns stay as they are.
    """
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the rate of its source says.

    A null source is a source of its own; one without tokens has rate 1. Null ids draw alike, and so do repeated rows.
    Columns stay as they are, whatever their names.
    """
    return mixing.mix(docs, copy_column=None)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shards.

    Null ids share the shard of ''; repeated rows share one. A column named ``shard``, in upper or lower case, is replaced.
    """
    return sharding.assign_shards(docs, slot_column=None)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("MinHash near-dedup", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can't walk the word graph or hash the signatures; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; an empty table of documents gives an empty one with a column ``shard``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
