"""The compact binary format of dictionaries: a bit-packed trie of keys and a store of values.

One dictionary is one binary value; many are a table (dict_id, content), built and read in parallel, one task a
dictionary.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.schema import COLUMNS, ENTRY, KINDS, RAW_ENTRY, TYPES

MAGIC, VERSION, HEADER = b"TRP\0", (1, 0), 32
HAS_VALUES, HAS_SUFFIXES = 1, 2
END, END_VALUE, SKIP, BRANCH, CONTROLS = 0, 1, 2, 5, 6
#: Offsets are 32 bits wide.
MAX_BITS = (1 << 32) - 1
#: Entries, and bytes of dictionaries, after which a decoded batch ends; a batch holds whole dictionaries.
BATCH_ROWS, BATCH_BYTES = 8192, 1 << 20


class Corrupt(ValueError):
    """The bytes are no dictionary of this format."""


def _varint(n: int) -> str:
    groups = []
    while True:
        n, low = n >> 7, n & 127
        groups.append(f"{low | (128 if n else 0):08b}")
        if not n:
            return "".join(groups)


def _zigzag(n: int) -> int:
    return n * 2 if n >= 0 else -n * 2 - 1


def _bits(data: bytes) -> str:
    return bin(int.from_bytes(b"\1" + data, "big"))[3:]


def _trie(keys: list[bytes], ends: list[str], code: dict[int, str], skip: str, branch: str) -> str:
    """The bits of a sorted, distinct list of keys. Subtrees are built from the last key back, so sizes are known when needed."""

    def node(lo: int, hi: int, depth: int) -> str:
        first, last = keys[lo], keys[hi - 1]
        common = depth
        while common < len(first) and common < len(last) and first[common] == last[common]:
            common += 1
        out = [code[b] for b in first[depth:common]]
        if len(first) == common:
            out.append(ends[lo])
            lo += 1
        if lo < hi:
            cuts = [lo, *(i for i in range(lo + 1, hi) if keys[i][common] != keys[i - 1][common]), hi]
            parts = [node(a, b, common) for a, b in zip(cuts, cuts[1:])]
            out += [branch, _varint(len(parts))]
            for part in parts[:-1]:
                out += [skip, _varint(len(part)), part]
            out.append(parts[-1])
        return "".join(out)

    return node(0, len(keys), 0) if keys else ""


def pack(items: dict[bytes, tuple[int, object]], bits_per_symbol: int | None = None) -> bytes:
    """The dictionary of keys with (tag, payload); arrays and nested dictionaries are refused."""
    import sys

    keys = sorted(items)
    alphabet = sorted({b for k in keys for b in k})
    count = len(alphabet) + CONTROLS
    if count > 255:
        raise ValueError("keys of more than 249 distinct bytes don't fit the format")
    width = max(1, (count - 1).bit_length())
    if bits_per_symbol is not None:
        if not width <= bits_per_symbol <= 15:
            raise ValueError(f"{count} symbols need {width} bits, not {bits_per_symbol}")
        width = bits_per_symbol
    symbol = lambda n: f"{n:0{width}b}"
    code = {b: symbol(CONTROLS + i) for i, b in enumerate(alphabet)}
    valued = any(tag for tag, _ in items.values())
    config = f"{width:04b}{count:08b}" + "".join(symbol(i) for i in range(CONTROLS)) + "".join(map(_varint, alphabet))
    ends = [symbol(END_VALUE) + _varint(i) if items[k][0] else symbol(END) for i, k in enumerate(keys)]
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 1000 + 2 * max(map(len, keys), default=0)))
    try:
        trie = _trie(keys, ends, code, symbol(SKIP), symbol(BRANCH))
    finally:
        sys.setrecursionlimit(limit)
    parts, size = [config, trie], len(config) + len(trie)
    for k in keys if valued else ():
        part = _value_bits(*items[k], size)
        parts.append(part)
        size += len(part)
    if size > MAX_BITS:
        raise ValueError("the dictionary is larger than the format's offsets; split it")
    data = "".join(parts)
    data += "0" * (-len(data) % 8)
    head = MAGIC + struct.pack(">BBHIIIIII", *VERSION, HAS_VALUES * valued, len(keys), len(config), len(config) + len(trie), 0, size, 0)
    body = head + (int("1" + data, 2).to_bytes(len(data) // 8 + 1, "big")[1:] if data else b"")
    return body + struct.pack(">I", zlib.crc32(body))


def _value_bits(tag: int, v: object, position: int) -> str:
    """The bits of a value that begins at a bit position."""
    if not 0 <= tag <= 7:
        raise ValueError(f"the format has no values of kind {KINDS[tag] if 0 <= tag < len(KINDS) else tag}")
    out = f"{tag:04b}"
    if tag == 1:
        out += "1" if v else "0"
    elif tag == 2:
        out += _varint(_zigzag(int(v)))
    elif tag == 3:
        out += _varint(int(v))
    elif tag == 4:
        out += _bits(struct.pack(">f", v))
    elif tag == 5:
        out += _bits(struct.pack(">d", v))
    elif tag in (6, 7):
        data = v.encode() if isinstance(v, str) else bytes(v)
        out += _varint(len(data))
        out += "0" * (-(position + len(out)) % 8) + _bits(data)
    return out


class Bits:
    """A cursor over the bits of a dictionary."""

    def __init__(self, data: bytes):
        self.bits, self.at = _bits(data), 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise Corrupt("the data end early")
        self.at += n
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def varint(self) -> int:
        out = 0
        for shift in range(0, 70, 7):
            group = self.take(8)
            out |= (group & 127) << shift
            if group < 128:
                if out >> 64:
                    raise Corrupt("a number is over 64 bits")
                return out
        raise Corrupt("a number doesn't end")


def header(content: bytes, verify: bool = True) -> dict[str, int]:
    """The header's fields, after the checks of magic, version, checksum and features."""
    if len(content) < HEADER + 4:
        raise Corrupt("too short")
    if content[:4] != MAGIC:
        raise Corrupt("not a dictionary")
    names = ("version_major", "version_minor", "flags", "num_keys", "trie_offset", "value_offset", "suffix_offset", "total_bits", "reserved")
    out = dict(zip(names, struct.unpack(">BBHIIIIII", content[4:HEADER])))
    if out["version_major"] != VERSION[0]:
        raise Corrupt("an unknown version")
    if verify and struct.unpack(">I", content[-4:])[0] != zlib.crc32(content[:-4]):
        raise Corrupt("the checksum is wrong")
    if out["flags"] & HAS_SUFFIXES:
        raise Corrupt("suffix tables aren't supported")
    return out


def unpack(content: bytes, verify: bool = True) -> list[tuple[bytes, int, object]]:
    """(key, tag, payload) of every entry, in the order of the keys."""
    head = header(content, verify)
    r = Bits(content[HEADER:-4])
    width, count = r.take(4), r.take(8)
    controls = [r.take(width) for _ in range(CONTROLS)]
    names = {c: i for i, c in enumerate(controls)}
    letters = {CONTROLS + i: r.varint() for i in range(count - CONTROLS)}
    keys: list[tuple[bytes, bool]] = []
    if head["num_keys"]:
        r.at = head["trie_offset"]
        stop = head["value_offset"]
        stack: list[list] = []  # open branches: prefix and children to come
        prefix = bytearray()
        fresh = True
        while True:
            if fresh and stack:
                stack[-1][1] -= 1
                if stack[-1][1]:
                    if names.get(r.take(width)) != SKIP:
                        raise Corrupt("no skip before a child")
                    r.varint()
                fresh = False
            # a node: symbols, perhaps an end, perhaps a branch
            if r.at >= stop:
                break
            symbol = r.take(width)
            control = names.get(symbol)
            if control is None:
                if symbol not in letters:
                    raise Corrupt("an unknown symbol")
                prefix.append(letters[symbol])
                continue
            branch = False
            if control in (END, END_VALUE):
                if control == END_VALUE and r.varint() != len(keys):
                    raise Corrupt("a value out of order")
                keys.append((bytes(prefix), control == END_VALUE))
                here = r.at
                if r.at < stop and names.get(r.take(width)) == BRANCH and here + width <= stop:
                    branch = True
                else:
                    r.at = here
            elif control == BRANCH:
                branch = True
            else:
                raise Corrupt("an unexpected control code")
            if branch:
                stack.append([len(prefix), r.varint()])
                fresh = True
                continue
            while stack and not stack[-1][1]:
                stack.pop()
            if not stack:
                break
            del prefix[stack[-1][0] :]
            fresh = True
    if len(keys) != head["num_keys"]:
        raise Corrupt("the number of keys is wrong")
    if not head["flags"] & HAS_VALUES:
        return [(k, 0, None) for k, _ in keys]
    r.at = head["value_offset"]
    return [(k, *_value(r)) for k, _ in keys]


def _value(r: Bits) -> tuple[int, object]:
    tag = r.take(4)
    if tag == 0:
        return 0, None
    if tag == 1:
        return 1, bool(r.take(1))
    if tag == 2:
        z = r.varint()
        return 2, z >> 1 if not z & 1 else -(z >> 1) - 1
    if tag == 3:
        return 3, Decimal(r.varint())
    if tag == 4:
        return 4, struct.unpack(">f", r.take(32).to_bytes(4, "big"))[0]
    if tag == 5:
        return 5, struct.unpack(">d", r.take(64).to_bytes(8, "big"))[0]
    if tag in (6, 7):
        n = r.varint()
        r.at += -r.at % 8
        data = r.take(8 * n).to_bytes(n, "big")
        return tag, data.decode() if tag == 6 else data
    raise Corrupt(f"values of tag {tag} aren't supported")


_FIELD = {1: "v_bool", 2: "v_int", 3: "v_uint", 4: "v_f32", 5: "v_f64", 6: "v_str", 7: "v_blob"}
_PLACE = {tag: COLUMNS.index(c) for tag, c in _FIELD.items()}


def encode(entries: DataFrame, bits_per_symbol: int | None = None) -> DataFrame:
    """(dict_id, content): built entries as binary dictionaries.

    One shuffle on ``dict_id``. A dictionary is one task's work, as its bits depend on each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            cells = lists.flatten()
            keys, seqs, tags = (cells.field(k).to_pylist() for k in range(3))
            kinds = pc.fill_null(cells.field(2), -1).to_numpy(zero_copy_only=False)
            values: list = [None] * len(cells)
            for tag, column in _FIELD.items():
                at = np.flatnonzero(kinds == tag)
                if len(at):
                    for i, v in zip(at.tolist(), cells.field(3 + COLUMNS.index(column)).take(pa.array(at)).to_pylist()):
                        values[i] = v
            out, lo = [], 0
            for size in pc.list_value_length(lists).to_pylist():
                items: dict[bytes, tuple[int, object]] = {}
                for i in sorted(range(lo, lo + size), key=seqs.__getitem__):
                    key = keys[i].encode() if isinstance(keys[i], str) else bytes(keys[i])
                    items[key] = (tags[i], values[i])
                lo += size
                out.append(pack(items, bits_per_symbol))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["dict_id", "content"])

    return entries.groupBy("dict_id").agg(F.collect_list(F.struct("key", "seq", "tag", *COLUMNS)).alias("rows")).mapInArrow(run, "dict_id string, content binary")


_ARROW = {"boolean": pa.bool_(), "bigint": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0), "float": pa.float32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


def decode(files: DataFrame, verify: bool = True, raw: bool = False) -> DataFrame:
    """The entries of a table (dict_id, content); ``seq`` is the order of the keys. Keys are binary if ``raw``.

    A map over the rows. Content that fails a check raises an error; without ``verify`` the checksum isn't one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dict_id", "key", "seq", "tag", *COLUMNS]
        kinds = [pa.string(), pa.binary() if raw else pa.string(), pa.int64(), pa.int8(), *(_ARROW[t] for t in TYPES.values())]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), kinds)], names=names)
        empty = (None,) * len(COLUMNS)
        for batch in batches:
            rows, held = [], 0
            for dict_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if content is None:
                    continue
                for i, (k, tag, v) in enumerate(unpack(content, verify)):
                    at = _PLACE.get(tag)
                    cells = empty if at is None else (*empty[:at], v, *empty[at + 1 :])
                    rows.append((dict_id, k if raw else k.decode(), i, tag, *cells))
                held += len(content)
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    if rows:
                        yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return files.select(F.col("dict_id").cast("string").alias("dict_id"), "content").mapInArrow(run, RAW_ENTRY if raw else ENTRY)


def read(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The entries of binary files; ``dict_id`` is the file's path."""
    return decode(spark.read.format("binaryFile").load(path).select(F.col("path").alias("dict_id"), "content"), verify)


def headers(files: DataFrame) -> DataFrame:
    """(dict_id, fields of the header, valid): the metadata of a table (dict_id, content), without decoding it."""

    def number(offset: int, size: int) -> Column:
        return F.conv(F.hex(F.substring("content", offset + 1, size)), 16, 10).cast("bigint")

    n = F.octet_length("content")
    return files.select(
        "dict_id",
        (F.hex(F.substring("content", 1, 4)) == "54525000").alias("magic"),
        number(4, 1).alias("version_major"),
        number(5, 1).alias("version_minor"),
        number(6, 2).alias("flags"),
        (number(6, 2).bitwiseAND(HAS_VALUES) != 0).alias("has_values"),
        number(8, 4).alias("num_keys"),
        number(12, 4).alias("trie_offset"),
        number(16, 4).alias("value_offset"),
        number(24, 4).alias("total_bits"),
        F.shiftright(number(HEADER, 1), 4).alias("bits_per_symbol"),
        n.cast("bigint").alias("total_bytes"),
        valid(F.col("content")).alias("valid"),
    )


def valid(content: Column) -> Column:
    """Whether the last four bytes are the checksum of the others."""
    n = F.octet_length(content)
    tail = F.conv(F.hex(F.substring(content, n - 3, F.lit(4))), 16, 10).cast("bigint")
    return F.when(n >= HEADER + 4, F.crc32(F.substring(content, F.lit(1), n - 4)) == tail).otherwise(F.lit(False))


def dump(content: Column) -> Column:
    """The header in hexadecimal."""
    return F.hex(F.substring(content, 1, HEADER))
