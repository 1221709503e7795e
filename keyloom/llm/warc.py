"""Read web archives past damage: recover every valid record, and log the bytes in quarantine."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.tokens import partitions, total_bytes

#: Bytes of the records of one archive that :func:`pack` writes, before compression.
ARCHIVE_BYTES = 16 << 20
#: Bytes of a compressed file that one task reads.
SPLIT_BYTES = 64 << 20
#: Bytes that are read at a time, and the most that a record's header may have; a longer one counts as damage.
PIECE, MAX_HEADER = 1 << 18, 1 << 20
#: The most bytes of a record's block, or of a member once inflated: a value of a table holds no more than 2 GB. What
#: claims to be larger counts as damage.
MAX_BLOCK = 1 << 30
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/"
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r?\n")
_LENGTH = re.compile(r"[0-9]{1,18}")

#: ``kind`` is record, failure (a check failed at ``offset``) or end (of the file).
SCHEMA = "path string, offset long, end long, kind string, reason string, record_type string, record_id string, uri string, date string, payload binary"
Reader = Callable[[int, int], bytes]


class Damaged(Exception):
    """A check failed; the message says which. ``before`` has the records before the damage that hold their digests."""

    def __init__(self, reason: str, before: list[tuple[dict[str, str], bytes]] | None = None):
        super().__init__(reason)
        self.before = before or []


def _header(data: bytes) -> tuple[dict[str, str], int] | None:
    """(fields, length of the header), or None if the end of the header isn't there."""
    line = _VERSION_LINE.match(data)
    if not line:
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", line.end() - 2)
    if end < 0:
        return None
    fields = {}
    for text in data[line.end() : end].split(b"\r\n"):
        name, colon, value = text.partition(b":")
        if not colon and text:
            raise Damaged("bad header")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not _LENGTH.fullmatch(fields.get("content-length", "")):
        raise Damaged("no length")
    if int(fields["content-length"]) > MAX_BLOCK:
        raise Damaged("too large")
    return fields, end + 4


def _digest(fields: dict[str, str]) -> tuple[str, str] | None:
    """(method, digest) of the block, where it has one that can be checked."""
    method, _, digest = fields.get("warc-block-digest", "").partition(":")
    return (method.lower(), digest) if method.lower() in ("sha1", "md5", "sha256") else None


def _checked(fields: dict[str, str], block: bytes) -> tuple[dict[str, str], bytes]:
    if known := _digest(fields):
        method, digest = known
        found = hashlib.new(method, block)
        if digest.lower() != found.hexdigest() and digest.upper() != base64.b32encode(found.digest()).decode():
            raise Damaged("digest")
    return fields, block


def records(data: bytes, whole: bool = True) -> list[tuple[dict[str, str], bytes]]:
    """The records of a decompressed member; every one must be whole.

    Unless the member is ``whole``, those up to the first that fails, if a digest proves them.
    """
    out, at = [], 0
    try:
        while at < len(data):
            found = _header(data[at : at + MAX_HEADER])
            if found is None:
                raise Damaged("bad header")
            fields, size = found
            start, length = at + size, int(fields["content-length"])
            if start + length + 4 > len(data):
                raise Damaged("too short")
            if data[start + length : start + length + 4] != b"\r\n\r\n":
                raise Damaged("length")
            out.append(_checked(fields, data[start : start + length]))
            at = start + length + 4
        if not out:
            raise Damaged("empty member")
    except Damaged as damage:
        proven = [x for x in out if _digest(x[0])]
        if whole:
            raise Damaged(str(damage), proven) from None
        return proven
    return out if whole else [x for x in out if _digest(x[0])]


def member(read: Reader, at: int) -> tuple[int, list[tuple[dict[str, str], bytes]]]:
    """(end, records) of the gzip member at an offset."""
    inflate, out, here, size = zlib.decompressobj(31), [], at, 0

    def damaged(reason: str) -> Damaged:
        return Damaged(reason, records(b"".join(out), False))

    while not inflate.eof:
        piece = inflate.unconsumed_tail
        if not piece:
            piece = read(here, PIECE)
            if not piece:
                raise damaged("truncated")
            here += len(piece)
        try:
            out.append(inflate.decompress(piece, 16 * PIECE))
        except zlib.error as error:
            raise damaged("checksum" if "data check" in str(error) or "length check" in str(error) else "corrupt") from None
        size += len(out[-1])
        if len(out) == 1 and len(out[0]) >= len(VERSION) and not out[0].startswith(VERSION):
            raise Damaged("no version line")
        if size > MAX_BLOCK + MAX_HEADER:
            raise damaged("too large")
    return here - len(inflate.unused_data), records(b"".join(out))


def plain(read: Reader, at: int) -> tuple[int, list[tuple[dict[str, str], bytes]]]:
    """(end, records) of the uncompressed record at an offset. What ends the block is read before the block is."""
    size, found = 1 << 12, None
    while found is None:
        data = read(at, size)
        found = _header(data)
        if found is None and (len(data) < size or size >= MAX_HEADER):
            raise Damaged("bad header")
        size *= 4
    fields, start = found
    length = int(fields["content-length"])
    tail = read(at + start + length, 4)
    if len(tail) < 4:
        raise Damaged("truncated")
    if tail != b"\r\n\r\n":
        raise Damaged("length")
    return at + start + length + 4, [_checked(fields, read(at + start, length))]


def _next(read: Reader, at: int, hi: int, marks: tuple[bytes, ...]) -> int:
    """Where the first of ``marks`` begins from ``at`` on, or ``hi``."""
    while at < hi:
        piece = read(at, PIECE)
        places = [p for p in (piece.find(m) for m in marks) if p >= 0]
        if places:
            return min(hi, at + min(places))
        if len(piece) < PIECE:
            return hi
        at += len(piece) - max(map(len, marks)) + 1
    return hi


def salvage(read: Reader, size: int, lo: int = 0, hi: int | None = None) -> Iterator[tuple]:
    """(offset, end, kind, reason, fields, block) of what begins between ``lo`` and ``hi`` of a file of ``size`` bytes.

    ``read(offset, n)`` gives up to n bytes. A record is yielded if all its checks hold: a gzip member's checksum and
    length, the version line, the header, the content length and what follows it, and the block's digest if it
    has one. Where one fails, a failure is yielded, and the search goes on a byte further for the next member or
    version line. Of a member that fails, the records before the damage are yielded if their digests prove them, with no
    bytes of their own and the damage as their reason. A stretch that begins within a file looks for a member first. The
    last stretch ends with ``end``.

    An empty file has an end alone. A header of over MAX_HEADER bytes, a block of over MAX_BLOCK or a length that is no
    number of at most 18 ASCII digits is damage. Records of any size up to that are read whole.
    """
    hi = size if hi is None else min(hi, size)
    at = _next(read, lo, hi, (MAGIC,)) if lo else 0
    while at < hi:
        start = read(at, len(VERSION))
        try:
            if start.startswith(MAGIC):
                end, found = member(read, at)
            elif start == VERSION:
                end, found = plain(read, at)
            else:
                raise Damaged("garbage")
        except Damaged as damage:
            for fields, block in damage.before:
                yield at, at, "record", f"before damage: {damage}", fields, block
            yield at, None, "failure", str(damage), {}, None
            at = _next(read, at + 1, hi, (MAGIC, VERSION))
            continue
        for fields, block in found:
            yield at, end, "record", None, fields, block
        at = end
    if hi == size:
        yield size, size, "end", None, {}, None


def _batches(path: str, found: Iterator[tuple], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of SCHEMA, in batches of bounded size."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.binary()]
    rows, held = [], 0
    for offset, end, kind, reason, fields, block in found:
        rows.append((path, offset, end, kind, reason, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), block))
        held += len(block or b"") + 200
        if held >= most:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


def from_table(files: DataFrame) -> DataFrame:
    """The rows of SCHEMA from a table (path, content), one row a file, as the binaryFile source gives it.

    A null or empty content has no record and no gap. Rows of one path are read apart, but their gaps count as those of
    one file, so paths should differ. An empty table gives an empty one; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(batch.column(k) for k in range(2))):
                view = memoryview(content.as_buffer() if content.is_valid else b"")
                yield from _batches(path.as_py(), salvage(lambda at, n, v=view: bytes(v[at : at + n]), len(view)))

    return files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, SCHEMA)


def from_files(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The rows of SCHEMA from the files of a path or pattern.

    Compressed files (.gz) are read by several tasks, each from the first member of its stretch on; others by one. Tasks
    read ranges and never hold a file. The listing reads no content. Empty files have neither record nor gap.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    step = F.when(F.col("path").endswith(".gz"), F.lit(split_bytes)).otherwise(F.greatest("length", F.lit(1)))
    splits = listed.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), step.cast("long"))).alias("lo"), step.cast("long").alias("step"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, size, lo, step in zip(*(batch.column(k).to_pylist() for k in range(4))):
                system, name = fs.FileSystem.from_uri(where)
                with system.open_input_file(name) as file:
                    yield from _batches(where, salvage(lambda at, n, f=file: f.read_at(max(0, min(n, size - at)), at), size, lo, lo + step))

    return splits.repartition(F.col("path"), F.col("lo")).mapInArrow(run, SCHEMA)


def gaps(rows: DataFrame) -> DataFrame:
    """(path, offset, end, reason): the bytes that belong to no record, each as long as it can be.

    ``reason`` is the check that failed where the gap begins. Rows that begin before the end of an earlier record
    of their file aren't counted. Repeated rows change nothing; no rows have no gaps.
    """
    before = Window.partitionBy("path").orderBy("offset", "end").rowsBetween(Window.unboundedPreceding, -1)
    solid = rows.where("kind != 'failure'").select("path", "offset", "end").withColumn("past", F.coalesce(F.max("end").over(before), F.lit(0).cast("long")))
    found = solid.where("offset > past").select("path", F.col("past").alias("offset"), F.col("offset").alias("end"))
    why = rows.where("kind = 'failure'").groupBy("path", "offset").agg(F.min("reason").alias("reason"))
    return found.join(why, ["path", "offset"], "left").select("path", "offset", "end", F.coalesce("reason", F.lit("garbage")).alias("reason"))


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A page as an archive record."""
    block = (html or "").encode()
    fields = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", f"Content-Length: {len(block)}"]
    if url is not None:
        fields.insert(3, "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def compressed(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


FLIP, TRUNCATE, GARBAGE = 1, 2, 3


def pack(pages: DataFrame, damage: Column | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, content): the pages as compressed archives, a member each, about ``archive_bytes`` of records in a file.

    ``damage`` spoils members: FLIP inverts a byte in the middle, TRUNCATE cuts the last third, GARBAGE puts 64 bytes
    before. A null id, URL or text is left out or an empty block; pages of any size are written whole; repeated rows are
    records each, pages that tie in id and URL in any order. An empty table gives no archive; other columns aren't read.
    """
    number = max(1, total_bytes(pages, "html") // (archive_bytes // 2))
    rows = pages.select(F.pmod(F.xxhash64("page_id", "url"), F.lit(number)).alias("file"), F.col("page_id").try_cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.coalesce(damage if damage is not None else F.lit(0), F.lit(0)).cast("int").alias("damage"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, held, size = None, 0, [], 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{now:06d}-{part:04d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["path", "content"])

        for batch in batches:
            for file, page_id, url, html, spoiled in zip(*(batch.column(k) for k in range(5))):
                file = file.as_py()
                if file != now or size >= archive_bytes:
                    if held:
                        yield emit()
                    part = part + 1 if file == now else 0
                    now, held, size = file, [], 0
                data = record(page_id.as_py(), url.as_py(), html.as_py())
                size += len(data)
                kind, data = spoiled.as_py(), compressed(data)
                if kind == FLIP:
                    middle = len(data) // 2
                    data = data[:middle] + bytes([data[middle] ^ 0xFF]) + data[middle + 1 :]
                elif kind == TRUNCATE:
                    data = data[: -(len(data) // 3)]
                elif kind == GARBAGE:
                    data = b"\x1f\x8b\x08\x00damaged!" * 5 + b"\0" * 4 + data
                held.append(data)
        if held:
            yield emit()

    return rows.repartition(partitions(pages.sparkSession, number * archive_bytes // 2), "file").sortWithinPartitions("file", "page_id", "url").mapInArrow(run, "path string, content binary")


def measured(rows: DataFrame) -> DataFrame:
    """``rows`` with ``n_bytes`` and ``digest`` instead of the payload."""
    return rows.select("*", F.octet_length("payload").cast("long").alias("n_bytes"), F.md5("payload").alias("digest")).drop("payload")


def salvaged(rows: DataFrame) -> DataFrame:
    """(kind, path, offset, end, page_id, url, n_bytes, digest, reason): every record, and every gap in quarantine.

    ``rows`` has the size and MD5 of payloads (see :func:`measured`) in their stead. ``reason`` says why a gap begins, or
    of what damage a record was recovered before. Records without a page's id have a null one; no rows give none.
    """
    found = rows.where("kind = 'record'").select("kind", "path", "offset", "end", F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1).try_cast("long").alias("page_id"), F.col("uri").alias("url"), "n_bytes", "digest", "reason")
    lost = gaps(rows).select(F.lit("gap").alias("kind"), "path", "offset", "end", F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), (F.col("end") - F.col("offset")).alias("n_bytes"), F.lit(None).cast("string").alias("digest"), "reason")
    return found.unionByName(lost)
