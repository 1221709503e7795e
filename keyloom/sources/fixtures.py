"""The golden dictionaries, of which the sizes are published, and small documents with theirs."""

from __future__ import annotations

import os
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from keyloom.schema import COLUMNS, ENTRY
from keyloom.sources.trie import _FIELD, pack

#: {name: ({key: (tag, value)}, bytes in the binary format)}.
GOLDEN: dict[str, tuple[dict[str, tuple[int, object]], int]] = {
    "empty": ({}, 40),
    "single_null": ({"hello": (0, None)}, 48),
    "single_int": ({"key": (3, 42)}, 48),
    "keys_only": ({w: (0, None) for w in ("apple", "banana", "cherry")}, 65),
    "shared_prefix": ({k: (3, v) for v, k in zip((10, 20, 30), ("abc", "abd", "xyz"))}, 66),
    "multi_mixed": ({"uint": (3, 200), "str": (6, "hello"), "int": (2, -100), "f64": (5, 3.14159), "bool": (1, True)}, 102),
    "large": ({f"key_{i:04d}": (3, i) for i in range(100)}, 628),
}
#: {name: (document, keys, bytes in the binary format)}.
SMALL_DOCUMENTS = {
    "nothing": ("{}", 1, 50),
    "nested": ('{"db":{"host":"localhost","port":5432},"cache":{"ttl":300}}', 4, 103),
    "array": ('{"items":["alpha","beta","gamma","delta"]}', 5, 113),
    "mixed": ('{"str":"hello","int":42,"float":3.14,"bool":true,"null":null}', 6, 106),
}


def golden(spark: SparkSession) -> DataFrame:
    """The entries of all golden dictionaries; of the empty one there are none."""
    rows = []
    for name, (items, _) in GOLDEN.items():
        for seq, (key, (tag, v)) in enumerate(items.items()):
            rows.append((name, key, seq, tag, *(None if c != _FIELD.get(tag) else v for c in COLUMNS)))
    at = 4 + list(COLUMNS).index("v_uint")
    return spark.createDataFrame([(*r[:at], None if r[at] is None else Decimal(r[at]), *r[at + 1 :]) for r in rows], ENTRY)


def write(folder: str) -> list[str]:
    """A file for each golden dictionary; their paths."""
    os.makedirs(folder, exist_ok=True)
    paths = []
    for name, (items, _) in GOLDEN.items():
        paths.append(os.path.join(folder, name + ".trp"))
        with open(paths[-1], "wb") as file:
            file.write(pack({k.encode(): v for k, v in items.items()}))
    return paths
