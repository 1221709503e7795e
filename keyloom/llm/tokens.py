"""Token hashes of whole Arrow columns, without a Python loop over documents or words.

A token is a maximal run of ASCII letters, digits and non-ASCII bytes in the lower-cased text. Its hash is
a polynomial in its bytes modulo 2^64, taken from running sums over the buffer, then mixed. Null texts count
as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text that are hashed at a time; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 19

#: Bytes that one task of a shuffle is meant to read.
TASK_BYTES = 64 << 20


def total_bytes(df: DataFrame, column: str) -> int:
    """The bytes of a column of texts, by a scan of that column."""
    return df.agg(F.sum(F.octet_length(F.col(column).cast("string")).cast("long"))).first()[0] or 0


def partitions(spark: SparkSession, size: int) -> int:
    """Partitions for a shuffle of ``size`` bytes: those of the session, or as many as keep tasks at TASK_BYTES."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True
_EMPTY, _BREAK = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 18)
        have = np.full(size, base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def unmix(h: np.ndarray) -> np.ndarray:
    """The value that :func:`mix` makes ``h`` of."""
    back = U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
    h = h ^ (h >> U(32))
    h *= back
    h ^= h >> U(32)
    h *= back
    h ^= h >> U(32)
    return h


@dataclass
class Chunk:
    """Tokens of documents lo..hi-1 of a column; ``offsets`` and ``bounds`` have the first token and byte of each, and the end."""

    lo: int
    hi: int
    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    sums: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def doc_of(self) -> np.ndarray:
        """For each token, its document, counted from lo."""
        return np.repeat(np.arange(self.hi - self.lo), self.counts)

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def _lowered(texts: pa.Array) -> pa.Array:
    try:
        return pc.utf8_lower(texts)
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        return pa.array([x.as_buffer().to_pybytes().decode("utf-8", "replace").lower() for x in texts], pa.string())


def chunks(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES, lower: bool = True) -> Iterator[Chunk]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(lengths):
        return
    group = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
    for lo, hi in zip(cuts, cuts[1:]):
        part = texts.slice(lo, hi - lo)
        part = (_lowered(part) if lower else part).cast(pa.large_string())
        part = pc.binary_join_element_wise(part, _EMPTY, _BREAK)
        bounds = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        edge = np.diff(_WORD[data].view(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.empty(len(data) + 1, U)
        sums[0] = 0
        np.cumsum((data.astype(U) + U(1)) * powers(BASE, len(data)), out=sums[1:])
        yield Chunk(lo, hi, _hashed(sums, starts, ends), np.searchsorted(starts, bounds - bounds[0]), starts, ends, data, sums, bounds - bounds[0])


def _hashed(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(BASE_INV, len(sums))[starts])


def hash_words(words: list[str]) -> np.ndarray:
    """The hash of each of ``words``, every one of which is a single token."""
    out = [c.hashes for c in chunks(pa.array(words, pa.string()))]
    return np.concatenate(out) if out else np.empty(0, U)


SHINGLE = U(0xC2B2AE3D27D4EB4F)
SHINGLE_INV = U(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))


def windows(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every window of n tokens within one document, and the index of each one's first token."""
    h = chunk.hashes
    total = len(h)
    if total < n:
        return np.empty(0, U), np.empty(0, np.int64)
    sums = np.empty(total + 1, U)
    sums[0] = 0
    np.cumsum(h * powers(SHINGLE, total), out=sums[1:])
    rolled = (sums[n:] - sums[:-n]) * powers(SHINGLE_INV, total)[: total - n + 1]
    doc = chunk.doc_of()
    inside = np.flatnonzero(doc[: total - n + 1] == doc[n - 1 :])
    return mix(rolled[inside]), inside
