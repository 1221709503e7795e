"""A word graph by positive pointwise mutual information, and random walks with restarts over it.

Terms are 64-bit hashes. Two terms meet where at most WINDOW - 1 others stand between them, stop terms left out. All pairs
of terms are counted, in Spark; nothing here is a list of the vocabulary on one machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.decontaminate import Filter
from keyloom.llm.tokens import Chunk, U, mix
from keyloom.plans.sizing import map_texts, release

#: Terms on either side with which a term meets.
WINDOW = 3
#: Least meetings of the two terms of an edge, and the least signed root of the likelihood ratio of their independence: a
#: pair that met by chance is no edge.
EDGE_COUNT, EDGE_ROOT = 8, 6.0
#: Least classes of contents, out of 16, among the documents of an edge, or half of its meetings: copies of one document
#: make no edge.
EDGE_KINDS = 6
#: Probability to go on rather than restart at a seed, and steps of the walk; what is left then is below 2 % of the visits.
DAMPING, STEPS = 0.5, 6
#: The most frequent nodes, which tasks know by number. Pairs with another node go by hash; they get the same edges.
RANKED = 1 << 20
#: Meetings that a task holds before it sums them up and sends them, and pairs that a task of the next stage sums up.
HELD, PAIRS_PER_TASK = 1 << 21, 1 << 23
#: Keys that are worked on at a time, lest a task hold copies of all.
BLOCK = 1 << 16

#: Bits of a node's number; a key has two of them and 4 bits of a class, and room for a part of MOST_PARTS above.
_BITS = 20
_KEY_BITS = 2 * _BITS + 4
MOST_PARTS = 1 << (64 - _KEY_BITS)
_PACKED = "part int, size int, keys binary, counts binary"
_PAIRS = "a long, b long, k long, uses_a long, uses_b long, total long"


def signed_root(k: np.ndarray, n: np.ndarray, m: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The root of the likelihood ratio of a 2x2 table, negative where fewer than expected.

    k of ``total`` cases are of both kinds, n of the one and m of the other.
    """
    k, n, m, total = (np.asarray(x, float) for x in (k, n, m, total))
    cells = [(k, n, m), (n - k, n, total - m), (m - k, total - n, m), (total - n - m + k, total - n, total - m)]
    with np.errstate(divide="ignore", invalid="ignore"):
        g = sum(np.where(c > 0, c * np.log(c * total / (x * y)), 0) for c, x, y in cells)
    return np.sqrt(np.maximum(0, 2 * g)) * np.sign(k * total - n * m)


def signed_root_column(k: Column, n: Column, m: Column, total: Column) -> Column:
    """:func:`signed_root` of columns."""
    k, n, m, total = (x.cast("double") for x in (k, n, m, total))
    cells = [(k, n, m), (n - k, n, total - m), (m - k, total - n, m), (total - n - m + k, total - n, total - m)]
    g = sum((F.when(c > 0, c * F.log(c * total / (x * y))).otherwise(0.0) for c, x, y in cells), F.lit(0.0))
    return F.sqrt(F.greatest(F.lit(0.0), 2 * g)) * F.signum(k * total - n * m)


def meetings(hashes: np.ndarray, doc: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of the tokens that meet, for each distance up to ``window``."""
    for k in range(1, window + 1):
        left = np.flatnonzero((doc[k:] == doc[:-k]) & (hashes[k:] != hashes[:-k]))
        yield left, left + k


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key: that of its pair's first term and a stretch of second ones.

    The more parts, the shorter the stretches, so that the most frequent term is spread over as many parts as any.
    """
    stretch = _BITS - min(_BITS, max(0, parts.bit_length() - 6))
    out = np.empty(len(keys), np.int32)
    for lo in range(0, len(keys), BLOCK):
        out[lo : lo + BLOCK] = mix(keys[lo : lo + BLOCK] >> U(4 + stretch)) % U(parts)
    return out


def counted(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted by part and then by themselves, and how often each occurs.

    All is done in place, so that a task holds its meetings once: ``keys`` is overwritten, and the result is a view of it.
    """
    for lo in range(0, len(keys), BLOCK):
        block = keys[lo : lo + BLOCK]
        block |= part_of(block, parts).astype(U) << U(_KEY_BITS)
    keys.sort()
    counts = np.empty(len(keys), np.uint32)
    n, last = 0, ~keys[:1]
    for lo in range(0, len(keys), BLOCK):
        block = keys[lo : lo + BLOCK]
        start = np.flatnonzero(np.diff(block, prepend=last))
        if n:
            counts[n - 1] += start[0] if len(start) else len(block)
        last = block[-1:].copy()
        counts[n : n + len(start)] = np.diff(start, append=len(block))
        keys[n : n + len(start)] = block[start] & U((1 << _KEY_BITS) - 1)
        n += len(start)
    return keys[:n], counts[:n]


def packed(keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Sorted keys and their counts, split by part (see :func:`part_of`), as differences in planes of bytes, compressed.

    Neighbours differ by little, and take three bytes. Keys that are sorted by part, as :func:`counted` has them, stay in place.
    """
    part = part_of(keys, parts)
    if (part[1:] < part[:-1]).any():
        by = np.argsort(part, kind="stable")
        part, keys, counts = part[by], keys[by], counts[by]
    cuts = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        own = slice(cuts[p], cuts[p + 1])
        planes = (np.diff(keys[own], prepend=U(0)), counts[own].astype(np.uint32))
        blobs = (pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), "zstd", asbytes=True) for x in planes)
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([cuts[p + 1] - cuts[p]], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], names=["part", "size", "keys", "counts"])


def unpacked(size: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    def planes(blob: bytes, kind: type) -> np.ndarray:
        width = np.dtype(kind).itemsize
        raw = np.frombuffer(pa.decompress(blob, size * width, "zstd", asbytes=True), np.uint8)
        return np.ascontiguousarray(raw.reshape(width, size).T).view(kind).ravel()

    return np.cumsum(planes(keys, U), dtype=U), planes(counts, np.uint32)


def pairs(docs: DataFrame, terms: Callable, sketches: Callable, nodes: DataFrame, stop: np.ndarray, meetings_expected: int, window: int = WINDOW, ranked: int = RANKED) -> DataFrame:
    """(a, b, k, uses_a, uses_b, total): how often two nodes of a language meet, at least EDGE_COUNT times, EDGE_KINDS heeded.

    ``docs`` has (code, text), ``nodes`` (term, n, uses, total), ``stop`` the hashes of the stop terms of all languages.
    Tasks know the ``ranked`` most frequent nodes by number, so that a meeting travels in some four bytes; pairs with
    any other node are counted by hash in a second scan, which no smaller vocabulary needs.
    """
    spark = docs.sparkSession
    bucket = F.floor(8 * F.log2("n")).cast("int")
    sizes = nodes.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("bucket")).collect()  # some hundred rows
    within = np.cumsum([r["size"] for r in sizes]) <= ranked
    least = min((r.bucket for r, good in zip(sizes, within) if good), default=1 << 30)
    known = nodes.where(bucket >= least).select("term", "uses", "total").toArrow()
    terms_known = known.column("term").to_numpy().view(U)
    by = np.argsort(terms_known)
    shared = spark.sparkContext.broadcast((terms_known[by], np.sort(stop)))
    # apart, as only the tasks that sum up pairs read them
    sizes_known = spark.sparkContext.broadcast((known.column("uses").to_numpy()[by], known.column("total").to_numpy()[by]))
    parts = min(MOST_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-meetings_expected // PAIRS_PER_TASK)))

    def tokens_of(batches: Iterator[pa.RecordBatch], *filters: Filter) -> Iterator[tuple[np.ndarray, ...]]:
        """(hashes, documents, classes of contents) of the tokens that are no stop terms."""
        (stops,) = filters
        for batch in batches:
            for whole, chunk in terms(batch.column(1), batch.column(0)):
                good = np.ones(len(chunk.hashes), bool)
                good[stops.find(chunk.hashes)[0]] = False
                doc = chunk.doc_of()[good]
                yield chunk.hashes[good], doc, _kinds(whole, sketches)[doc]

    def by_number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, stops = Filter(shared.value[0]), Filter(shared.value[1])
        held, size = np.empty(HELD, U), 0
        for hashes, doc, kind in tokens_of(batches, stops):
            at, which = numbers.find(hashes)
            number = np.full(len(hashes), -1)
            number[at] = which
            for left, right in meetings(hashes, doc, window):
                a, b = number[left], number[right]
                good = (a >= 0) & (b >= 0)
                a, b = a[good], b[good]
                keys = ((np.minimum(a, b) << (_BITS + 4)) | (np.maximum(a, b) << 4) | kind[left[good]]).view(U)
                if size + len(keys) > HELD:
                    release()
                    yield from packed(*counted(held[:size], parts), parts)
                    size = 0
                if len(keys) > HELD:
                    yield from packed(*counted(keys, parts), parts)
                    continue
                held[size : size + len(keys)] = keys
                size += len(keys)
        release()
        yield from packed(*counted(held[:size], parts), parts)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [unpacked(*row) for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
        if not blobs:
            return
        keys, counts = (np.concatenate(x) for x in zip(*blobs))
        blobs.clear()
        by = np.argsort(keys)
        keys, counts = keys[by], counts[by]
        del by
        pair = keys >> U(4)
        start = np.flatnonzero(np.diff(pair, prepend=~pair[:1]))
        k = np.add.reduceat(counts, start, dtype=np.int64)
        kinds = np.bitwise_count(np.bitwise_or.reduceat(np.uint16(1) << (keys & U(15)).astype(np.uint16), start))
        good = (k >= EDGE_COUNT) & (kinds >= np.minimum(EDGE_KINDS, (k + 1) // 2))
        (hashes, _), (uses, total) = shared.value, sizes_known.value
        pair = pair[start[good]]
        a, b = ((pair >> U(_BITS)).astype(np.int64), (pair & U((1 << _BITS) - 1)).astype(np.int64))
        columns = (hashes[a].view(np.int64), hashes[b].view(np.int64), k[good], uses[a], uses[b], total[a])
        for lo in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in columns], names=[x.split()[0] for x in _PAIRS.split(", ")])
        release()

    out = map_texts(docs, by_number, _PACKED).repartitionById(parts, "part").mapInArrow(summed, _PAIRS)
    if all(within):
        return out

    def by_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, stops = Filter(shared.value[0]), Filter(shared.value[1])
        for hashes, doc, kind in tokens_of(batches, stops):
            other = np.ones(len(hashes), bool)
            other[numbers.find(hashes)[0]] = False
            for left, right in meetings(hashes, doc, window):
                some = other[left] | other[right]
                x, y = hashes[left[some]].view(np.int64), hashes[right[some]].view(np.int64)
                columns = (np.minimum(x, y), np.maximum(x, y), np.int32(1) << kind[left[some]].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "kinds"])

    rest = map_texts(docs, by_hash, "a long, b long, kinds int").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.bit_count(F.bit_or("kinds")).alias("kinds"))
    rest = rest.where((F.col("k") >= EDGE_COUNT) & (F.col("kinds") >= F.least(F.lit(EDGE_KINDS), F.floor((F.col("k") + 1) / 2))))
    a = nodes.select(F.col("term").alias("a"), F.col("uses").alias("uses_a"), "total")
    b = nodes.select(F.col("term").alias("b"), F.col("uses").alias("uses_b"))
    return out.unionByName(rest.drop("kinds").join(a, "a").join(b, "b"))


def _kinds(chunk: Chunk, sketches: Callable) -> np.ndarray:
    return (mix(sketches(chunk, 1)[:, 0]) >> U(60)).astype(np.int64)


def edges(counted: DataFrame, window: int = WINDOW) -> DataFrame:
    """(a, b, pmi): the pairs of :func:`pairs` with positive mutual information that didn't meet by chance.

    Of the ``total`` tokens of a language each has 2 * ``window`` places beside it, so that two terms would meet in
    2 * window * uses_a * uses_b / total of them if they were independent.
    """
    places = F.lit(2 * window)
    root = signed_root_column(F.col("k"), places * F.col("uses_a"), places * F.col("uses_b"), places * F.col("total"))
    pmi = F.log(F.col("k") * F.col("total").cast("double") / (places * F.col("uses_a").cast("double") * F.col("uses_b")))
    return counted.where((root >= EDGE_ROOT) & (pmi > 0)).select("a", "b", pmi.alias("pmi"))


def walk(graph: DataFrame, origin: DataFrame, columns: list[str], damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """(term, *columns): the visits of one random walk a column over the undirected ``graph`` of (a, b, pmi).

    ``origin`` has the chances to restart at each term. A walk goes to a neighbour by the share of its pmi. Terms
    without an edge keep what they have. Every step is a join and a sum on the same key, so that only visits are
    shuffled; the graph is shuffled once.
    """
    both = graph.select(F.col("a").alias("term"), F.col("b").alias("to"), "pmi").unionByName(graph.select(F.col("b").alias("term"), F.col("a").alias("to"), "pmi"))
    strength = both.groupBy("term").agg(F.sum("pmi").alias("strength"))
    both = both.join(strength, "term").select("term", "to", (damping * F.col("pmi") / F.col("strength")).alias("share"))
    here = origin.join(strength.select("term"), "term", "left_semi")
    restart = here.select("term", *[((1 - damping) * F.col(c)).alias(c) for c in columns])
    visits = here
    for _ in range(steps):
        moved = visits.join(both, "term").select(F.col("to").alias("term"), *[(F.col(c) * F.col("share")).alias(c) for c in columns])
        visits = moved.unionByName(restart).groupBy("term").agg(*[F.sum(c).alias(c) for c in columns])
    return visits.unionByName(origin.join(strength.select("term"), "term", "left_anti"))
