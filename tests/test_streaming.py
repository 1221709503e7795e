"""The change journal."""

from pyspark.sql import functions as F

from keyloom import schema
from keyloom.operators.build import read
from keyloom.streaming import journal


def test_changes_are_merged_once(spark, tmp_path):
    source, root = str(tmp_path / "changes"), str(tmp_path / "dictionary")

    def change(rows):
        df = spark.createDataFrame(rows, "k string, v int, s int, deleted boolean")
        made = df.select("k", "v", "s", "deleted").withColumn("x", schema.int64(F.col("v")))
        entries = made.select(F.lit("").alias("dict_id"), F.col("k").alias("key"), F.col("s").cast("bigint").alias("seq"), "x.*", "deleted")
        entries.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(entries.schema).parquet(source)
        query = journal.follow(stream, root, str(tmp_path / "checkpoint"))
        query.awaitTermination()
        _, path = journal.latest(spark, root)
        return {r.key: r.v_int for r in read(spark, path).collect()}

    assert change([("a", 1, 1, False), ("b", 2, 2, False)]) == {"a": 1, "b": 2}
    assert change([("a", 5, 3, False), ("b", 0, 4, True), ("c", 7, 5, False)]) == {"a": 5, "c": 7}
    before = journal.latest(spark, root)
    merge = journal.apply(root)
    merge(spark.createDataFrame([], schema.ENTRY + ", deleted boolean"), before[0])
    assert journal.latest(spark, root) == before
    for number in range(before[0] + 1, before[0] + 4):
        merge(spark.createDataFrame([], schema.ENTRY + ", deleted boolean"), number)
    assert [n for n, _ in journal._versions(spark, root)[1]] == [before[0] + 2, before[0] + 3]
    assert {r.key: r.v_int for r in read(spark, journal.latest(spark, root)[1]).collect()} == {"a": 5, "c": 7}
