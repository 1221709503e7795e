"""Dictionaries and documents as objects, for use in a program or shell. Each method returns a lazy DataFrame or one value."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from keyloom import schema
from keyloom.operators import build, lookup, search
from keyloom.operators import json_documents as documents
from keyloom.schema import COLUMNS, VALUE
from keyloom.sources import trie

_KIND = {bool: "bool", int: "int", float: "float64", str: "string", bytes: "blob", type(None): "null"}


class Encoder:
    """Collects entries, in any order; the last of equal keys counts."""

    def __init__(self, spark: SparkSession, dict_id: str = ""):
        self.spark, self.dict_id = spark, dict_id
        self.rows: list[tuple] = []

    def insert(self, key: str, value: Any = None, kind: str | None = None) -> Encoder:
        kind = kind or _KIND[type(value)]
        if kind == "int" and value > (1 << 63) - 1:
            kind = "uint"
        tag = schema.KINDS.index(kind)
        column = schema.PAYLOAD.get(kind, (None,))[0] if value is not None else None
        from decimal import Decimal

        payload = Decimal(value) if kind == "uint" else value
        self.rows.append((self.dict_id, key, len(self.rows), 0 if value is None else tag, *(payload if c == column else None for c in schema.COLUMNS)))
        return self

    def __len__(self) -> int:
        """Entries so far, equal keys included."""
        return len(self.rows)

    def reset(self) -> Encoder:
        self.rows.clear()
        return self

    def entries(self) -> DataFrame:
        return build.build(self.spark.createDataFrame(self.rows, schema.ENTRY))

    def encode(self) -> bytes:
        """The binary form."""
        rows = trie.encode(self.entries()).collect()
        return bytes(rows[0].content) if rows else trie.pack({})


class Dictionary:
    """Built entries of one dictionary."""

    def __init__(self, entries: DataFrame):
        self.entries = entries

    @classmethod
    def decode(cls, spark: SparkSession, content: bytes, verify: bool = True) -> Dictionary:
        return cls(trie.decode(spark.createDataFrame([("", content)], "dict_id string, content binary"), verify))

    def __len__(self) -> int:
        return self.entries.count()

    def __contains__(self, key: str) -> bool:
        return not lookup.get(self.entries, key).isEmpty()

    def lookup(self, key: str) -> Row | None:
        """The entry, or None; a null value that is present is a row of tag 0."""
        return lookup.get(self.entries, key).first()

    def info(self) -> Row | None:
        return lookup.info(self.entries).first()

    def __iter__(self) -> Iterator[Row]:
        """Entries in key order, a partition at a time."""
        return search.scan(self.entries).toLocalIterator()

    def prefix(self, text: str) -> DataFrame:
        return search.prefix(self.entries, text)

    def fuzzy(self, query: str, distance: int) -> DataFrame:
        return search.fuzzy(self.entries, query, distance)

    def encode(self) -> bytes:
        rows = trie.encode(self.entries).collect()
        return bytes(rows[0].content) if rows else trie.pack({})


class Json:
    """JSON text to the binary form and back."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def encode(self, text: str) -> bytes:
        docs = self.spark.createDataFrame([("", text)], "doc_id string, json string")
        entries = documents.to_entries(documents.flatten(docs), docs)
        return bytes(trie.encode(entries).first().content)

    def open(self, content: bytes) -> JsonHandle:
        return JsonHandle(trie.decode(self.spark.createDataFrame([("", content)], "dict_id string, content binary")))

    def decode(self, content: bytes, indent: str | int | None = None) -> str:
        entries = trie.decode(self.spark.createDataFrame([("", content)], "dict_id string, content binary"))
        return documents.unflatten(documents.from_entries(entries), indent).select(F.col("json")).first()[0]


class JsonHandle:
    """A document in the binary form, opened to look paths up and to go through its leaves."""

    def __init__(self, entries: DataFrame):
        self.entries = entries
        self.leaves = documents.from_entries(entries)

    def lookup(self, path: str) -> tuple[bool, object]:
        """(found, value) of a path; containers aren't leaves and so aren't found."""
        row = self.leaves.where((F.col("path") == path) & ~F.col("tag").isin(8, 9)).select(*VALUE).first()
        return (False, None) if row is None else (True, _value(row))

    def __iter__(self) -> Iterator[tuple[str, object]]:
        """(path, value) of every leaf, in the order of the document."""
        for row in self.leaves.orderBy("seq", "path").toLocalIterator():
            yield row.path, _value(row)

    def __len__(self) -> int:
        return self.leaves.count()

    def root_type(self) -> str | None:
        """object or array."""
        row = self.entries.where(F.col("key") == documents.ROOT_KEY).select(F.coalesce("v_uint", "v_int")).first()
        return {1: "object", 2: "array"}.get(int(row[0])) if row else None


def _value(row: Row) -> object:
    v = next((row[c] for c in COLUMNS if row[c] is not None), None)
    return int(v) if isinstance(v, Decimal) else {8: [], 9: {}}.get(row.tag, v)
