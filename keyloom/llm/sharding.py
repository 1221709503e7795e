"""Place documents on shards through a lookup table that the shards fill by turns."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.plans.names import fresh, others

#: Slots of the table, a prime; at least 100 slots a shard keep loads within one per cent of each other.
TABLE_SIZE = 65537
SHARDS = [f"shard-{i:03d}" for i in range(128)]
#: Largest table that may be broadcast.
MAX_TABLE = 1 << 21


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % p for p in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """For each of ``size`` slots, the index of its shard.

    Every shard has a preference order of all slots, (offset + j * skip) mod size; since size is prime, it is a
    permutation. The shards take turns in the order of their names, each claiming its next preferred slot that is
    free. Loads differ by one slot at most, and a shard that is added or removed moves few other slots.
    """
    if not _is_prime(size) or size > MAX_TABLE:
        raise ValueError(f"the table size must be a prime up to {MAX_TABLE}, not {size}")
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shard names must be unique, at least one, and no more than slots")
    turn = sorted(range(len(shards)), key=lambda i: shards[i])
    place = [_number("offset:" + s) % size for s in shards]
    skip = [_number("skip:" + s) % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for i in turn[:left]:
            while table[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % size
            table[place[i]] = i
            left -= 1
    return np.array(table, np.int32)


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key; null counts as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def assign_shards(docs: DataFrame, shards: list[str] = SHARDS, size: int = TABLE_SIZE, key: str = "doc_id", slot_column: str | None = "slot", shard_column: str = "shard") -> DataFrame:
    """``docs`` with the slot and shard of each row, without a shuffle.

    The table has ``size`` rows whatever the data, and is broadcast. Rows with one key, repeated rows included, share a
    shard; null keys are placed as ''; keys may be of any type that has a text. Texts of any length are passed on and
    not read. An empty table gives an empty one. Input columns named as ``slot_column`` or ``shard_column``, in upper or
    lower case, are replaced, others passed on.
    """
    at, slot, shard = fresh(docs, "__at", "__slot", "__shard")
    table = [(k, shards[i]) for k, i in enumerate(lookup_table(shards, size).tolist())]
    placed = F.broadcast(docs.sparkSession.createDataFrame(table, f"{slot} int, {shard} string"))
    new = {slot_column: slot} if slot_column else {}
    joined = docs.withColumn(at, slot_of(F.col(key), size)).join(placed, F.col(at) == F.col(slot))
    return joined.select(*others(docs, slot_column, shard_column), *[F.col(v).alias(k) for k, v in (new | {shard_column: shard}).items()])


def oracle_sql(shards: list[str] = SHARDS, size: int = TABLE_SIZE) -> str:
    """The placement in SQL, on the finished table; how it is filled is tested on its own."""
    return f"""
WITH slots AS (SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {size})::INT AS slot FROM documents),
     filled AS (SELECT {lookup_table(shards, size).tolist()} AS t)
SELECT slots.*, printf('shard-%03d', t[slot + 1]) AS shard FROM slots, filled
"""
