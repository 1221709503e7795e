"""Decide by measured size between a broadcast and a shuffle."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows that are ever collected for a broadcast. 200k narrow rows are a few MB.
MAX_COLLECTED_ROWS = 200_000

#: Bytes of an Arrow batch of texts, in a session that keeps Spark's default. A task holds several batches at once, in
#: the JVM and in Python.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_texts(df: DataFrame, f: Callable, schema) -> DataFrame:
    """``df.mapInArrow(f, schema)`` in batches of at most BATCH_BYTES, unless the session names a size of its own.

    A task gives back what it freed when it ends.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, "67108864b") == "67108864b":
        conf.set(_BATCH, f"{BATCH_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give freed memory back to the machine: a Python worker that waits for its next task shares it with others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def collect_bounded(df: DataFrame, max_rows: int = MAX_COLLECTED_ROWS) -> list | None:
    """The rows of ``df`` if there are at most ``max_rows``, else None.

    Never brings more than ``max_rows + 1`` rows to the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def small_side(df: DataFrame, max_rows: int = MAX_COLLECTED_ROWS) -> DataFrame:
    """``df`` computed once and marked for broadcast when it is small; else ``df`` as it is.

    The join that uses the result is the same either way: beyond ``max_rows`` Spark shuffles both
    sides, and AQE splits skewed partitions.
    """
    rows = collect_bounded(df, max_rows)
    if rows is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
