"""Broadcasts by size, written tables and fresh names."""

import os

import pytest
from pyspark.sql import functions as F

from keyloom.plans import lineage, names, sizing


def test_small_sides_are_broadcast_and_large_ones_not(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    plan = lambda side: spark.range(1000).join(side, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(sizing.small_side(df)).lower()
    assert "broadcast" not in plan(sizing.small_side(df, 10)).lower()
    assert sizing.small_side(df).count() == 100 and sizing.collect_bounded(df, 99) is None and len(sizing.collect_bounded(df, 100)) == 100


def test_a_cut_table_is_written_and_dropped(spark):
    df = spark.range(10).withColumn("x", F.lit("a"))
    written = lineage.cut(df, "test")
    path = written._keyloom_path.removeprefix("file://")
    assert sorted(map(tuple, written.collect())) == [(i, "a") for i in range(10)] and os.path.isdir(path)
    assert "Range" not in written._jdf.queryExecution().toString()
    lineage.drop(written)
    assert not os.path.exists(path)
    assert lineage.shared_dir(spark) == lineage.shared_dir(spark)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError, match="checkpoint.dir"):
        lineage.shared_dir(Session())


def test_fresh_names(spark):
    df = spark.range(1).selectExpr("id", "1 AS __KEY", "2 AS other")
    assert names.fresh(df, "__key", "n") == ["__key_", "n_"] and names.fresh(df, "a") == ["a"]


def test_batches_of_texts_are_bounded(spark):
    df = spark.range(300).select(F.expr("repeat('x', 1000000)").alias("t"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    assert max(r.n for r in sizing.map_texts(df, run, "n long").collect()) < 2 * sizing.BATCH_BYTES
