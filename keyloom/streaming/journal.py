"""Keep a dictionary up to date from a stream of changes. An extension: batch operators do the work of each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from keyloom.operators.build import build, read, replay, write


def version_path(root: str, version: int) -> str:
    return f"{root}/version={version:012d}"


def _versions(spark: SparkSession, root: str) -> tuple:
    """(file system, [(number, path)] of the complete versions below ``root``, in their order)."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return system, []
    done = [str(s.getPath()) for s in system.listStatus(folder) if system.exists(jvm.org.apache.hadoop.fs.Path(str(s.getPath()) + "/_SUCCESS"))]
    return system, sorted((int(p.rpartition("=")[2]), p) for p in done if "version=" in p)


def latest(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """(number, path) of the newest complete version below ``root``."""
    versions = _versions(spark, root)[1]
    return versions[-1] if versions else None


def forget(spark: SparkSession, root: str, keep: int) -> None:
    """Delete all complete versions but the newest ``keep``; a reader of the newest isn't disturbed."""
    system, versions = _versions(spark, root)
    for _, path in versions[:-keep]:
        system.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def apply(root: str, keep: int = 2):
    """A function for foreachBatch that merges a batch of changes (entries with ``deleted``) into the newest version.

    The version has the number of the batch, so a batch that is repeated writes the same version again, or none if
    it was complete. Of older versions, the newest stay, ``keep`` in all.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = latest(spark, root)
        if now and now[0] >= number:
            return
        base = read(spark, now[1]) if now else build(batch.drop("deleted").limit(0))
        write(replay(base, batch), version_path(root, number))
        forget(spark, root, keep)

    return merge


def follow(changes: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Merge a stream of changes until it has no more to give."""
    return changes.writeStream.foreachBatch(apply(root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
