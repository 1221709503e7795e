"""Reject texts whose zstandard ratio lies outside the band of their length."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.plans.sizing import map_texts

LEVEL = 3
CHUNK_BYTES = 4096
#: (least bytes, lowest ratio, highest ratio or (least bytes, highest ratio) of several) of compressed to plain bytes. Frame overhead makes short texts look
#: incompressible, and long ones share more, so the limits fall with the length. Below 128 bytes no ratio is too high,
#: as prose of that length doesn't shrink either; below 32 none is too low. From
#: 1 kB on, Base64 (0.76 at best) is above the highest, prose well below.
#: Below that, the highest ratio falls within a band by lengths of its own, between prose and random Base64 of the length.
_HIGHEST_128 = ((128, 0.98), (144, 0.97), (160, 0.95), (192, 0.9), (224, 0.88))
_HIGHEST_256 = ((256, 0.86), (320, 0.84), (384, 0.82), (448, 0.79), (512, 0.77), (640, 0.76), (768, 0.75), (896, 0.74))
BANDS = ((0, 0.0, 99.0), (32, 0.45, 99.0), (128, 0.35, _HIGHEST_128), (256, 0.32, _HIGHEST_256), (1024, 0.25, 0.74), (4096, 0.2, 0.7), (32768, 0.15, 0.7))
#: Limits of a whole chunk, and the share of a document's chunks that may lie outside. A text of one chunk is that chunk, and
#: the limits of its length are narrower than these.
CHUNK_BAND = (0.15, 0.72)
MAX_BAD_CHUNKS = 0.25

SCHEMA = "doc_id long, n_bytes long, ratio double, chunks int, low_chunk double, high_chunk double, bad_chunks int, band int, reason string"


def measure(text: bytes, compressor: zstandard.ZstdCompressor, chunk: int = CHUNK_BYTES) -> tuple[float, list[float]]:
    """The ratio of the whole text, and of each chunk; a last chunk of under half the size belongs to the one before."""
    if not text:
        return 0.0, []
    whole = len(compressor.compress(text)) / len(text)
    if len(text) < chunk * 3 // 2:
        return whole, [whole]
    cuts = list(range(0, len(text), chunk))
    if len(text) - cuts[-1] < chunk // 2:
        cuts.pop()
    view = memoryview(text)
    return whole, [len(compressor.compress(part)) / len(part) for part in (view[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)]))]


def verdict(size: int, whole: float, chunks: list[float], bands=BANDS, chunk_band=CHUNK_BAND, max_bad: float = MAX_BAD_CHUNKS) -> tuple[int, int, str | None]:
    """(index of the band, chunks outside the chunk band, why it is rejected or None)."""
    band = max(i for i, b in enumerate(bands) if size >= b[0])
    bad = sum(not chunk_band[0] <= x <= chunk_band[1] for x in chunks) if len(chunks) > 1 else 0
    _, low, high = bands[band]
    if isinstance(high, tuple):
        high = max(b for b in high if size >= b[0])[1]
    if size == 0:
        return band, 0, "empty"
    if whole < low:
        return band, bad, "repetitive"
    if whole > high:
        return band, bad, "incompressible"
    return band, bad, "chunks" if bad > max_bad * len(chunks) else None


def compression_bands(docs: DataFrame, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, chunk_band=CHUNK_BAND, max_bad: float = MAX_BAD_CHUNKS, level: int = LEVEL) -> DataFrame:
    """One row a document: its ratios, its band, and ``reason``, which is null for what is kept.

    ``reason`` is 'repetitive' or 'incompressible' where the ratio of the whole text leaves the band of its length,
    'chunks' where more than ``max_bad`` of its chunks leave ``chunk_band``, 'empty' for null and empty texts. A map
    over the rows: nothing is shuffled, and texts of any length are read whole. A ratio that ties with a limit is
    kept. Repeated rows give repeated rows, null ids stay null, ids that are no integers become null, an empty table gives
    an empty one, other columns, whatever their names, aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            rows = []
            for text in texts:
                data = text.as_buffer()
                plain = data.to_pybytes() if len(data) else b""
                whole, parts = measure(plain, compressor, chunk_bytes)
                band, bad, why = verdict(len(plain), whole, parts, bands, chunk_band, max_bad)
                rows.append((len(plain), whole, len(parts), min(parts, default=None), max(parts, default=None), bad, band, why))
            kinds = (pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string())
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return map_texts(docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCHEMA)


def kept(docs: DataFrame, **limits) -> DataFrame:
    """The rows of :func:`compression_bands` that aren't rejected."""
    return compression_bands(docs, **limits).where(F.col("reason").isNull()).drop("reason")
