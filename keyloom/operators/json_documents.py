"""Flatten JSON documents into typed paths, look paths up, and build the documents again.

Documents are rows (doc_id, json). A flat document has a row a leaf: its path as text, its path as segments (a name or
an index each), and a tagged value. Empty containers are leaves of kind array or dict.
"""

from __future__ import annotations

import base64
import json
import math
import re
import sys
from array import array
from collections.abc import Iterator, Sequence
from decimal import Decimal
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.plans.sizing import collect_bounded
from keyloom.schema import COLUMNS, KINDS, PAYLOAD, TYPES, VALUE

MAX_DEPTH = 32
#: The key under which a dictionary keeps the type of a document's root (1 object, 2 array).
ROOT_KEY = "\x01root"
FLAT = "doc_id string, seq bigint, path string, segments array<struct<name: string, idx: bigint>>, tag tinyint, " + ", ".join(f"{c} {t}" for c, t in TYPES.items())
_INT_MIN, _INT_MAX, _UINT_MAX = -(1 << 63), (1 << 63) - 1, (1 << 64) - 1
_LARGEST = sys.float_info.max


class SyntaxFault(ValueError):
    """The text is no JSON document."""


class DepthFault(ValueError):
    """The document is nested too deeply."""


class _Number(str):
    """The text of a number; leading zeros are allowed."""


_SPACE = re.compile(r"[ \t\r\n]*")
_NUMBER = re.compile(r"-?\d+(\.\d+)?([eE][+-]?\d+)?")
_STRING = json.decoder.scanstring


def _string(text: str, at: int) -> tuple[str, int]:
    """(string, end) of what begins after a quote; half of a surrogate pair is no character."""
    try:
        out, end = _STRING(text, at, True)
        out.encode()
    except (json.JSONDecodeError, IndexError, UnicodeEncodeError) as fault:
        raise SyntaxFault(str(fault)) from None
    return out, end


def leaves(text: str, max_depth: int = MAX_DEPTH) -> tuple[str, list[tuple[tuple, object]]]:
    """(root type, [(segments, value)]) of a document; names are str and indexes int.

    What follows the root is ignored; the last of equal names counts, at the place of the first. An empty container is
    the value {} or [].
    """

    def value(at: int, depth: int, path: tuple, out: dict) -> int:
        at = _SPACE.match(text, at).end()
        c = text[at : at + 1]
        if c == "{" or c == "[":
            if depth >= max_depth:
                raise DepthFault(f"nested deeper than {max_depth}")
            return container(at + 1, c, depth + 1, path, out)
        if c == '"':
            out[path], end = _string(text, at + 1)
            return end
        for word, v in (("true", True), ("false", False), ("null", None)):
            if text.startswith(word, at):
                out[path] = v
                return at + len(word)
        number = _NUMBER.match(text, at)
        if not number:
            raise SyntaxFault(f"no value at {at}")
        out[path] = _Number(number.group())
        return number.end()

    def container(at: int, kind: str, depth: int, path: tuple, out: dict) -> int:
        close, n, mine = ("}", 0, {}) if kind == "{" else ("]", 0, {})
        at = _SPACE.match(text, at).end()
        if text.startswith(close, at):
            out[path] = {} if kind == "{" else []
            return at + 1
        while True:
            if kind == "{":
                at = _SPACE.match(text, at).end()
                if not text.startswith('"', at):
                    raise SyntaxFault(f"no name at {at}")
                step, at = _string(text, at + 1)
                at = _SPACE.match(text, at).end()
                if not text.startswith(":", at):
                    raise SyntaxFault(f"no colon at {at}")
                at += 1
            else:
                step, n = n, n + 1
            inner: dict = {}
            at = value(at, depth, (*path, step), inner)
            mine[step] = inner
            at = _SPACE.match(text, at).end()
            if text.startswith(",", at):
                at += 1
            elif text.startswith(close, at):
                for part in mine.values():
                    out.update(part)
                return at + 1
            else:
                raise SyntaxFault(f"no comma or {close} at {at}")

    start = _SPACE.match(text).end()
    if text[start : start + 1] not in ("{", "["):
        raise SyntaxFault("the root must be an object or an array")
    out: dict = {}
    value(start, 0, (), out)
    return ("object" if text[start] == "{" else "array"), list(out.items())


class _Refused(ValueError):
    pass


def _constant(name: str) -> None:
    raise _Refused(name)


_DECODER = json.JSONDecoder(parse_constant=_constant)
_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")


def _walk(v: object, path: tuple, depth: int, max_depth: int, out: list) -> None:
    if isinstance(v, (dict, list)):
        if depth >= max_depth:
            raise DepthFault(f"nested deeper than {max_depth}")
        for step, x in v.items() if isinstance(v, dict) else enumerate(v):
            _walk(x, (*path, step), depth + 1, max_depth, out)
        if v:
            return
    out.append((path, v))


def decoded(text: str) -> object:
    """What Python's own decoder makes of a document, or None where :func:`leaves` must parse it."""
    start = _SPACE.match(text).end()
    if text[start : start + 1] in ("{", "[") and not _SURROGATE.search(text):
        try:
            return _DECODER.raw_decode(text, start)[0]
        except (ValueError, RecursionError):
            pass
    return None


def quick_leaves(text: str, max_depth: int = MAX_DEPTH) -> list[tuple[tuple, object]]:
    """The leaves of :func:`leaves`, by Python's own decoder where it accepts the text; what it refuses is parsed there."""
    v = decoded(text)
    if v is None:
        return leaves(text, max_depth)[1]
    out: list = []
    _walk(v, (), 0, max_depth, out)
    return out


def path_text(segments: tuple) -> str:
    """a.b[0] from names and indexes."""
    return "".join(f"[{s}]" if isinstance(s, int) else (f".{s}" if i else s) for i, s in enumerate(segments))


def segments_of(path: str) -> tuple:
    """The inverse of :func:`path_text`, where no name holds a dot or a bracket."""
    return tuple(int(i) if i else n for n, i in re.findall(r"(?:^|\.)([^.\[]*)|\[(\d+)\]", path) if i or n or path == "") if path else ()


def typed(v: object) -> tuple[int, str | None, object]:
    """(tag, payload column, payload) of a parsed value; numbers beyond 64 bits are held at the limit of their kind."""
    if v is None:
        return 0, None, None
    if isinstance(v, bool):
        return 1, "v_bool", v
    if isinstance(v, float) or isinstance(v, _Number) and any(c in v for c in ".eE"):
        return 5, "v_f64", max(-_LARGEST, min(float(v), _LARGEST))
    if isinstance(v, (int, _Number)):
        n = int(v) if isinstance(v, int) else _bounded(v)
        if n <= _INT_MAX:
            return 2, "v_int", max(n, _INT_MIN)
        return 3, "v_uint", Decimal(min(n, _UINT_MAX))
    if isinstance(v, str):
        return 6, "v_str", v
    return (8, "v_str", "[]") if isinstance(v, list) else (9, "v_str", "{}")


def _bounded(digits: str) -> int:
    """The integer of a text of any length, held at 20 digits."""
    sign, size = (-1, digits[1:].lstrip("0")) if digits.startswith("-") else (1, digits.lstrip("0"))
    return sign * (int(size or "0") if len(size) <= 20 else 10**20)


_ARROW = {"boolean": pa.bool_(), "bigint": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0), "float": pa.float32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


#: Distinct paths that a task keeps from one batch to the next.
MAX_PATHS = 1 << 16


class _Paths:
    """The paths that occurred, numbered; most documents of a table have the same ones."""

    def __init__(self) -> None:
        self.known: list[tuple[str, tuple, tuple]] = [("", (), ())]
        self.kids: list[dict] = [{}]

    def step(self, parent: int, step: str | int) -> int:
        """The number of the path that goes on from one by a name or an index."""
        at = self.kids[parent].get(step)
        if at is None:
            path, names, places = self.known[parent]
            if isinstance(step, str):
                self.known.append((f"{path}.{step}" if parent else step, (*names, step), (*places, None)))
            else:
                self.known.append((f"{path}[{step}]", (*names, None), (*places, step)))
            at = self.kids[parent][step] = len(self.kids)
            self.kids.append({})
        return at

    def columns(self, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """The paths and the segments of some numbers."""
        used, where = np.unique(at, return_inverse=True)
        rows = [self.known[i] for i in used.tolist()]
        ends = np.append(0, np.cumsum([len(r[1]) for r in rows])).astype(np.int32)
        parts = pa.StructArray.from_arrays([pa.array([x for r in rows for x in r[1]], pa.string()), pa.array([x for r in rows for x in r[2]], pa.int64())], ["name", "idx"])
        take = pa.array(where.astype(np.int64))
        return pa.array([r[0] for r in rows], pa.string()).take(take), pa.ListArray.from_arrays(pa.array(ends), parts).take(take)


def _flat(batches: Iterator[pa.RecordBatch], max_depth: int, keep_empty: bool, bad: str) -> Iterator[pa.RecordBatch]:
    """A batch of leaves for each batch of documents."""
    names = ["doc_id", "seq", "path", "segments", "tag", *COLUMNS]
    of_column = [[tag for tag, kind in enumerate(KINDS) if kind in PAYLOAD and PAYLOAD[kind][0] == c] for c in COLUMNS]
    paths = _Paths()
    for batch in batches:
        if len(paths.known) > MAX_PATHS:
            paths = _Paths()
        step, kids = paths.step, paths.kids
        at, tags, counts = array("q"), bytearray(), []
        payloads: list[list] = [[] for _ in COLUMNS]
        by_tag = {tag: payloads[k] for k, own in enumerate(of_column) for tag in own}
        bools, integers, floats, strings = (by_tag[t] for t in (1, 2, 5, 6))

        def leaf(path: int, v: object) -> None:
            tag, column, payload = typed(v)
            if column:
                by_tag[tag].append(payload)
            at.append(path)
            tags.append(tag)

        def walk(path: int, depth: int, v: dict | list) -> None:
            if depth >= max_depth:
                raise DepthFault(f"nested deeper than {max_depth}")
            if not v:
                if keep_empty or not depth:
                    leaf(path, v)
                return
            mine = kids[path]
            for name, x in v.items() if type(v) is dict else enumerate(v):
                own = mine.get(name) or step(path, name)
                kind = type(x)  # the kinds that documents are made of come first
                if kind is str:
                    tags.append(6)
                    strings.append(x)
                elif kind is int and _INT_MIN <= x <= _INT_MAX:
                    tags.append(2)
                    integers.append(x)
                elif kind is dict or kind is list:
                    walk(own, depth + 1, x)
                    continue
                elif kind is bool:
                    tags.append(1)
                    bools.append(x)
                elif kind is float and -_LARGEST <= x <= _LARGEST:
                    tags.append(5)
                    floats.append(x)
                else:
                    leaf(own, x)
                    continue
                at.append(own)

        for doc, text in enumerate(batch.column(1).to_pylist()):
            first = len(tags)
            try:
                v = None if text is None else decoded(text)
                if v is not None:
                    walk(0, 0, v)
                elif text is not None:
                    for segments, x in leaves(text, max_depth)[1]:
                        if keep_empty or not segments or not isinstance(x, (dict, list)):
                            leaf(reduce(step, segments, 0), x)
            except (SyntaxFault, DepthFault) as fault:
                if bad == "error":
                    raise ValueError(f"document {batch.column(0)[doc]}: {fault}") from None
                for k, own in enumerate(of_column):
                    size = sum(tags.count(tag, first) for tag in own)
                    del payloads[k][len(payloads[k]) - size :]
                del tags[first:], at[first:]
            counts.append(len(tags) - first)
        kinds, sizes = np.frombuffer(bytes(tags), np.int8), np.array(counts, np.int64)
        path, segments = paths.columns(np.array(at, np.int64))
        columns = []
        for values, own, t in zip(payloads, of_column, TYPES.values()):
            if values:
                mine = np.isin(kinds, own)
                columns.append(pa.array(values, _ARROW[t]).take(pa.array(np.cumsum(mine) - 1, mask=~mine)))
            else:
                columns.append(pa.nulls(len(kinds), _ARROW[t]))
        seq = np.arange(len(kinds)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(seq), path, segments, pa.array(kinds), *columns], names=names)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("json").cast("string").alias("json"))


def flatten(docs: DataFrame, max_depth: int = MAX_DEPTH, keep_empty: bool = True, bad: str = "error") -> DataFrame:
    """The leaves of documents (doc_id, json), in their order (``seq``).

    A map over the rows, so nothing is shuffled. Values are typed as null, bool, float64 (with a point or exponent), int,
    uint (beyond the signed range) or string. A document that is no JSON (half of a surrogate pair included), whose root is a scalar, or that is nested
    deeper than ``max_depth`` raises an error, or has no leaves if ``bad`` is 'skip'; null has none. Without
    ``keep_empty``, empty containers below the root vanish.
    """
    if bad not in ("error", "skip"):
        raise ValueError("bad must be 'error' or 'skip'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _flat(batches, max_depth, keep_empty, bad)

    return _texts(docs).mapInArrow(run, FLAT)


def faults(docs: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(doc_id, fault): the documents that :func:`flatten` refuses, with 'syntax' or 'depth'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    if text is not None:
                        quick_leaves(text, max_depth)
                except SyntaxFault:
                    rows.append((doc_id, "syntax"))
                except DepthFault:
                    rows.append((doc_id, "depth"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], names=["doc_id", "fault"])

    return _texts(docs).mapInArrow(run, "doc_id string, fault string")


def assemble(items: list[tuple[tuple, object]]) -> object:
    """The document of leaves; the elements of an array are in the order of their indexes."""
    if not items:
        return {}
    if len(items) == 1 and not items[0][0]:
        return items[0][1]
    groups: dict = {}
    for segments, v in items:
        if segments:
            groups.setdefault(segments[0], []).append((segments[1:], v))
    if all(isinstance(k, int) for k in groups):
        return [assemble(groups[k]) for k in sorted(groups)]
    return {k if isinstance(k, str) else f"[{k}]": assemble(v) for k, v in groups.items()}


class _Node(dict):
    """A container that is being built, by names or indexes."""


def _finished(node: _Node) -> object:
    """The container of a node, or KeyError where it has both names and indexes."""
    kinds = {type(k) for k in node}
    if kinds == {str}:
        for k, v in node.items():
            if type(v) is _Node:
                node[k] = _finished(v)
        return node
    if kinds != {int}:
        raise KeyError
    return [_finished(v) if type(v) is _Node else v for _, v in sorted(node.items(), key=itemgetter(0))]


def _assembled(steps: list, ends: list[int], values: list, order: Sequence[int]) -> object:
    """:func:`assemble` of the leaves in ``order``, at once where no two are in each other's way."""
    root = _Node()
    try:
        for i in order:
            node, lo, hi = root, ends[i], ends[i + 1] - 1
            if hi < lo:
                raise KeyError
            for step in steps[lo:hi]:
                inner = node.get(step)
                if type(inner) is not _Node:
                    if step in node:
                        raise KeyError
                    inner = node[step] = _Node()
                node = inner
            if steps[hi] in node:
                raise KeyError
            node[steps[hi]] = values[i]
        return _finished(root)
    except KeyError:
        return assemble([(tuple(steps[ends[i] : ends[i + 1]]), values[i]) for i in order])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, leaves) of batches (doc_id, leaf): the leaves of a document that lie together become one row."""
    for batch in batches:
        ids, leaf = batch.column(0), batch.column(1)
        if len(ids):
            same = pc.fill_null(pc.equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, ~same))
            ends = pa.array(np.append(starts, len(ids)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(starts)), pa.ListArray.from_arrays(ends, leaf)], names=["doc_id", "leaves"])


def objects(column: pa.Array) -> np.ndarray:
    """The values of a column as Python's own, in a fraction of the time of ``to_pylist`` where they aren't decimals."""
    out = np.empty(len(column), object)
    out[:] = column.to_pylist() if pa.types.is_decimal(column.type) or column.null_count else column.to_numpy(zero_copy_only=False).tolist()
    return out


def _built(batches: Iterator[pa.RecordBatch], indent: str | int | None, blobs: bool) -> Iterator[pa.RecordBatch]:
    """Documents of rows (doc_id, leaves)."""
    encode = json.JSONEncoder(ensure_ascii=False, indent=indent, separators=(",", ":") if indent is None else None, allow_nan=False).encode
    for batch in batches:
        lists = batch.column(1)
        cells = lists.flatten()
        seq, segments, tag, *payloads = (cells.field(k) for k in range(cells.type.num_fields))
        parts = segments.flatten()
        named = parts.field(0).is_valid().to_numpy(zero_copy_only=False)
        cell = np.empty(len(parts), object)
        cell[named] = objects(parts.field(0).filter(pa.array(named)))
        cell[~named] = objects(parts.field(1).filter(pa.array(~named)))
        steps = cell.tolist()
        ends = np.append(0, np.cumsum(pc.list_value_length(segments).to_numpy(zero_copy_only=False))).tolist()
        cell = np.empty(len(cells), object)
        for column in payloads:
            if column.null_count < len(column):
                valid = column.is_valid()
                cell[valid.to_numpy(zero_copy_only=False)] = objects(column.filter(valid))
        values = cell.tolist()
        kinds = pc.fill_null(tag, -1).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(~np.isin(kinds, (0, 1, 2, 6))).tolist():
            v = values[i]
            if kinds[i] in (8, 9):
                values[i] = json.loads(v)
            elif kinds[i] == 7:
                values[i] = base64.b64encode(v).decode() if blobs and v is not None else None
            elif isinstance(v, Decimal):
                values[i] = int(v)
            elif isinstance(v, float) and not math.isfinite(v):
                values[i] = None
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = seq.to_numpy(zero_copy_only=False)
        turn = range(len(place))
        if np.any((np.diff(place) < 0) & (np.diff(owner) == 0)):
            turn = np.lexsort((place, owner)).tolist()
        out, lo = [], 0
        for size in sizes.tolist():
            out.append(encode(_assembled(steps, ends, values, turn[lo : lo + size])))
            lo += size
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "json"])


def unflatten(flat: DataFrame, indent: str | int | None = None, blobs: bool = False) -> DataFrame:
    """(doc_id, json): the documents of leaves, the inverse of :func:`flatten`.

    One shuffle on ``doc_id``, of a row for all leaves of a document that lie together; a document is built by one task.
    Members are in the order of ``seq``. Indexes order the elements of arrays by number. Blobs are null, or base64 if
    ``blobs``; NaN and infinities, which JSON has not, are null. ``indent`` makes the text pretty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _built(batches, indent, blobs)

    leaf = flat.select("doc_id", F.struct("seq", "segments", *VALUE).alias("leaf"))
    kind = leaf.schema["leaf"].dataType.simpleString()
    runs = leaf.mapInArrow(_together, f"doc_id {leaf.schema['doc_id'].dataType.simpleString()}, leaves array<{kind}>")
    rows = runs.groupBy("doc_id").agg(F.flatten(F.collect_list("leaves")).alias("rows"))
    return rows.mapInArrow(run, "doc_id string, json string")


def rebuilt(docs: DataFrame, max_depth: int = MAX_DEPTH, bad: str = "error") -> DataFrame:
    """(doc_id, json): every document flattened and built again from its leaves, as by ``unflatten(flatten(docs))``.

    A document is a row, so that its leaves lie together and nothing is shuffled; rows of equal ids stay apart. One
    without leaves (null, or skipped) is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat in _flat(batches, max_depth, True, bad):
            starts = np.flatnonzero(flat.column("seq").to_numpy() == 0)
            leaf = pa.StructArray.from_arrays([flat.column(c) for c in ("seq", "segments", *VALUE)], ["seq", "segments", *VALUE])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(leaf)).astype(np.int32)), leaf)
            yield from _built(iter([pa.RecordBatch.from_arrays([flat.column("doc_id").take(pa.array(starts)), lists], names=["doc_id", "leaves"])]), None, False)

    return _texts(docs).mapInArrow(run, "doc_id string, json string")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, cell), those with a cell, and of a run of others of one document the first."""
    for batch in batches:
        ids, keep = batch.column(0), batch.column(1).is_valid().to_numpy(zero_copy_only=False).copy()
        if len(ids):
            again = pc.fill_null(pc.equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False)
            keep |= np.append(True, ~again)
        yield batch.filter(pa.array(keep))


def lookup_paths(flat: DataFrame, paths: DataFrame) -> DataFrame:
    """(doc_id, path, found, value): every path of every document; containers aren't leaves and so aren't found.

    Leaves are read once. Those of other paths than ``paths`` only say that there is a document, and no leaves are broadcast.
    """
    paths = paths.select("path").distinct()
    rows = collect_bounded(paths)
    if rows is None:
        cells = flat.select("doc_id", "path", F.lit(True).alias("__found"), *VALUE).hint("merge")
        wanted = flat.select("doc_id").distinct().crossJoin(paths)
        return wanted.join(cells, ["doc_id", "path"], "left").select("doc_id", "path", F.coalesce("__found", F.lit(False)).alias("found"), *VALUE)
    small = F.broadcast(flat.sparkSession.createDataFrame(rows, "path string"))
    known = flat.join(small.withColumn("__found", F.lit(True)), "path", "left")
    cell = F.struct("path", F.lit(True).alias("found"), *VALUE)
    seen = known.select("doc_id", F.when(F.col("__found"), cell).alias("cell"))
    docs = seen.mapInArrow(_cells, seen.schema).groupBy("doc_id").agg(F.collect_list("cell").alias("cells"))
    every = F.broadcast(small.agg(F.array_agg(F.struct("path")).alias("every")))
    none = lambda x: F.struct(x["path"].alias("path"), F.lit(False).alias("found"), *[F.lit(None).cast(t).alias(c) for c, t in {"tag": "tinyint", **TYPES}.items()])
    missing = F.array_except("every", F.transform("cells", lambda x: F.struct(x["path"].alias("path"))))
    return docs.crossJoin(every).select("doc_id", F.inline(F.concat("cells", F.transform(missing, none))))


def _variant_path(path: str) -> str:
    """The path as Spark's variants have it; names may hold quotes, but no dots or brackets, at which paths are split."""
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f".{s}" for s in segments_of(path))


def at_path(doc: Column, path: str, kind: str = "string") -> Column:
    """The value at a path of a JSON text, as ``kind``, or null; a container is JSON text. Stays in the JVM."""
    return F.try_variant_get(F.try_parse_json(doc), _variant_path(path), kind)


def has_path(doc: Column, path: str) -> Column:
    """Whether there is a value at a path, null included."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(doc), _variant_path(path), "variant").isNotNull(), F.lit(False))


def root_type(doc: Column) -> Column:
    """object or array; null for what is neither."""
    first = F.substring(F.ltrim(doc, F.lit(" \t\r\n")), 1, 1)
    return F.when(first.isin("{", "[") & F.try_parse_json(doc).isNotNull(), F.when(first == "{", "object").otherwise("array"))


def count_top_level(doc: Column) -> Column:
    """Members of the root object, or elements of the root array."""
    return F.coalesce(F.json_array_length(doc), F.size(F.json_object_keys(doc)))


def count_leaves(flat: DataFrame) -> DataFrame:
    return flat.groupBy("doc_id").agg(F.count(F.lit(1)).alias("leaves"))


def _count(v: dict | list, depth: int, max_depth: int) -> int:
    """The leaves below a container; an empty one is a leaf."""
    if depth >= max_depth:
        raise DepthFault(f"nested deeper than {max_depth}")
    n = 0
    for x in v.values() if type(v) is dict else v:
        kind = type(x)
        n += _count(x, depth + 1, max_depth) if kind is dict or kind is list else 1
    return n or 1


def with_leaf_counts(docs: DataFrame, max_depth: int = MAX_DEPTH, bad: str = "error") -> DataFrame:
    """(doc_id, json, leaves): each document with as many leaves as :func:`flatten` makes of it; one without is left out.

    A map over the rows, which makes and shuffles no leaves; rows of equal ids are counted apart.
    """
    if bad not in ("error", "skip"):
        raise ValueError("bad must be 'error' or 'skip'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, counts = [], []
            for doc, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    v = decoded(text)
                    n = len(leaves(text, max_depth)[1]) if v is None else _count(v, 0, max_depth)
                except (SyntaxFault, DepthFault) as fault:
                    if bad == "error":
                        raise ValueError(f"document {batch.column(0)[doc]}: {fault}") from None
                    continue
                rows.append(doc)
                counts.append(n)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(counts, pa.int64())], names=["doc_id", "json", "leaves"])

    return _texts(docs).mapInArrow(run, "doc_id string, json string, leaves bigint")


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, key, value): the members or elements of the roots, ``value`` as JSON text; ``key`` is null in arrays."""
    spark = docs.sparkSession
    exploded = docs.select("doc_id", F.parse_json("json").alias("v")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return exploded.select("doc_id", "pos", "key", F.to_json("value").alias("value"))


def to_entries(flat: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Entries (the document is the dictionary, the path the key); with ``docs``, also the type of each root."""
    out = flat.select(F.col("doc_id").alias("dict_id"), F.col("path").alias("key"), "seq", *VALUE)
    if docs is None:
        return out
    kind = F.when(root_type(F.col("json")) == "object", 1).otherwise(2).cast("decimal(20,0)")
    roots = docs.select(F.col("doc_id").cast("string").alias("dict_id"), F.lit(ROOT_KEY).alias("key"), F.lit(-1).cast("bigint").alias("seq"), F.lit(3).cast("tinyint").alias("tag"), *[(kind if c == "v_uint" else F.lit(None).cast(t)).alias(c) for c, t in TYPES.items()])
    return out.where("not (key = '' and tag in (8, 9))").unionByName(roots)


def from_entries(entries: DataFrame) -> DataFrame:
    """Leaves of entries, whose keys are split at dots and brackets; keys that begin with \\x01 are no paths.

    A document of which only the root's type is there is an empty object or array. Entries are read once, by one shuffle
    on ``dict_id``.
    """
    step = F.regexp_extract_all(F.col("key"), F.lit(r"\[(\d+)\]|(?:^|\.)([^.\[]*)"), F.lit(0))
    name = lambda s: F.when(s.startswith("["), F.lit(None).cast("string")).otherwise(F.regexp_replace(s, r"^\.", ""))
    idx = lambda s: F.when(s.startswith("["), F.regexp_extract(s, r"\d+", 0).cast("bigint"))
    segments = F.filter(F.transform(step, lambda s: F.struct(name(s).alias("name"), idx(s).alias("idx"))), lambda s: s["idx"].isNotNull() | (s["name"] != ""))
    is_path = F.coalesce(~F.startswith("key", F.lit("\x01")), F.lit(False))
    marked = entries.where(is_path | (F.col("key") == ROOT_KEY)).withColumn("__path", is_path)
    known = marked.withColumn("__paths", F.max("__path").over(Window.partitionBy("dict_id"))).where("__path or not __paths")
    of = lambda path, root: F.when(F.col("__path"), path).otherwise(root)
    is_array = F.coalesce("v_uint", "v_int") == 2
    mark, mark_tag = F.when(is_array, "[]").otherwise("{}"), F.when(is_array, 8).otherwise(9).cast("tinyint")
    none = F.array().cast("array<struct<name: string, idx: bigint>>")
    cells = [of(F.col(c), mark if c == "v_str" else F.lit(None).cast(t)).alias(c) for c, t in TYPES.items()]
    return known.select(F.col("dict_id").alias("doc_id"), of(F.col("seq"), F.lit(0).cast("bigint")).alias("seq"), of(F.col("key"), F.lit("")).alias("path"), of(segments, none).alias("segments"), of(F.col("tag"), mark_tag).alias("tag"), *cells)
