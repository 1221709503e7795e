"""Cut lineage through tables in the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a written table that may be broadcast.
MAX_TABLE_ROWS = 1_000_000

_written: list[tuple[SparkSession, str]] = []
#: The temporary folder of each application that names none; no setting of the session is changed.
_temporary: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where that is unset and all runs on one machine, as in tests.

    On a cluster, a folder that not all executors share would lose tables with a machine, so an error is raised.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = _temporary.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="keyloom-")
        _temporary[context.applicationId] = named
    return named.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Every executor can read the table again, so the loss of one costs no recomputation. The table is
    dropped by :func:`drop` or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keyloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._keyloom_path = path
    return out


def sized(table: DataFrame, max_rows: int = MAX_TABLE_ROWS) -> DataFrame:
    """A narrow written table, marked for broadcast where it is small; its row count comes from the footers."""
    return F.broadcast(table) if table.count() <= max_rows else table


def drop(df: DataFrame) -> None:
    """Delete the table behind a result of :func:`cut`."""
    path = getattr(df, "_keyloom_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [(s, p) for s, p in _written if p != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, path)
            except Exception:  # the JVM may be gone when the driver ends
                return
