"""Names for columns that an operator adds on its way."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with so many underscores after them that ``df`` has no such column."""
    taken, tail = {c.lower() for c in df.columns}, ""
    while any((n + tail).lower() in taken for n in names):
        tail += "_"
    return [n + tail for n in names]


def others(df: DataFrame, *names: str | None) -> list[str]:
    """The columns of ``df`` but ``names``, in upper or lower case."""
    gone = {n.lower() for n in names if n}
    return [c for c in df.columns if c.lower() not in gone]
