"""Near-duplicates by one-permutation hashing with optimal densification, banded buckets and star-shaped edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.tokens import Chunk, U, chunks, mix, windows
from keyloom.plans.lineage import cut, drop, sized
from keyloom.plans.names import fresh
from keyloom.plans.sizing import map_texts

#: Tokens of a shingle; bins of a signature; values in a band. Four 16-bit values fill a 64-bit band.
SHINGLE_TOKENS = 3
BINS = 192
ROWS = 4
#: Least share of equal bins, an estimate of the Jaccard similarity of two shingle sets: half of the union. Copies with a few
#: edits lie above it, short texts with the same boilerplate line below.
THRESHOLD = 0.5

#: PREFERENCE[a, j]: the bin that empty bin j asks at its attempt a; a permutation for each j.
PREFERENCE = np.argsort(np.random.default_rng(7).random((BINS, BINS)), axis=0)

SIGNATURES = "doc_id long, key long, bands array<long>"


def signatures_of(chunk: Chunk, n: int = SHINGLE_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """(documents with a token, their signatures of BINS 16-bit values) for the documents of a chunk.

    Every distinct shingle falls in one bin by its hash; the bin keeps its least hash. An empty bin takes the value of
    the first filled bin in an order of its own, the same in all documents. A document with fewer than n tokens is one
    shingle.
    """
    counts = chunk.counts
    h, first = windows(chunk, n)
    doc = chunk.doc_of()[first]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.zeros(len(short), U)
        for k in range(n - 1):
            there = counts[short] > k
            whole[there] = mix(whole[there] + chunk.hashes[chunk.offsets[short[there]] + k])
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
    bits = U(max(1, len(counts).bit_length()))
    order = np.sort((doc.astype(U) << (U(64) - bits)) | (h >> bits))
    # the same 40 bits of a hash count, however many documents a chunk has
    doc, h = (order >> (U(64) - bits)).astype(np.int64), (order << bits) & U(0xFFFFFFFFFF000000)
    at = doc * BINS + (((h >> U(32)) * U(BINS)) >> U(32)).astype(np.int64)
    least = np.flatnonzero(np.diff(at, prepend=-1))
    sig, filled = np.zeros(len(counts) * BINS, np.uint16), np.zeros(len(counts) * BINS, bool)
    sig[at[least]] = mix(h[least]).astype(np.uint16)
    filled[at[least]] = True
    some = np.flatnonzero(counts > 0)
    sig, filled = sig.reshape(-1, BINS)[some], filled.reshape(-1, BINS)[some]
    row, empty = np.nonzero(~filled)
    for attempt in range(BINS):
        if not len(row):
            break
        donor = PREFERENCE[attempt][empty]
        found = filled[row, donor]
        sig[row[found], empty[found]] = sig[row[found], donor[found]]
        row, empty = row[~found], empty[~found]
    return some, sig


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, key, bands) of every document with a token; ``key`` is a hash of id and text, ``bands`` the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                some, sig = signatures_of(chunk)
                width = BINS // ROWS
                flat = pa.array(np.ascontiguousarray(sig).view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * width + 1, width, dtype=np.int32)), flat)
                where = pa.array(some + chunk.lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), lists], names=["doc_id", "key", "bands"])

    return map_texts(docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), key_of().alias("key"), F.col("text").cast("string").alias("text")), run, SIGNATURES)


def key_of() -> Column:
    """Equal for rows of equal id and text only (but for collisions of 64 bits); ids may be of any type."""
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"))


def star_edges(sigs: DataFrame) -> DataFrame:
    """(a, b), a < b, distinct: in each bucket of a band, its least key with every other one.

    A bucket of m documents gives m - 1 pairs, not m^2. The least key is found by aggregation, so a bucket that holds
    much of the corpus isn't gathered in one task, and AQE splits its join.
    """
    banded = sigs.select("key", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "key")
    hubs = banded.groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a < z").drop("z")
    return banded.join(hubs, "bucket").where("a < key").select("a", F.col("key").alias("b")).distinct()


def verified(edges: DataFrame, sigs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The edges (a, b) with at least ``threshold`` of the bins equal, and that share as ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(i).flatten().to_numpy().view(np.uint16).reshape(-1, BINS) for i in (2, 3))
            same = (left == right).mean(axis=1) if batch.num_rows else np.empty(0)
            good = np.flatnonzero(same >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), pa.array(same[good])], names=["a", "b", "similarity"])

    one = sigs.select("key", "bands").dropDuplicates(["key"])
    x = edges.join(one.select(F.col("key").alias("a"), F.col("bands").alias("x")), "a")
    xy = x.join(one.select(F.col("key").alias("b"), F.col("bands").alias("y")), "b").select("a", "b", "x", "y")
    return xy.mapInArrow(run, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the graph but the roots; a root is the least node of its component.

    Alternates large-star and small-star steps, which keep the number of edges at most as it is, and
    writes each round's edges in the shared folder. Minima come from aggregation, so a node with very many
    neighbours is no hot task.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = cut(small.where("u > v").distinct(), "edges")
        drop(now)
        now, was, seen = after, seen, state(after)
        if seen == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, key, keep_id, keep_key, group_size): a row for each document of each group of two or more.

    A group is a connected component of candidate pairs whose signatures agree in ``threshold`` of the bins. It keeps
    its least (doc_id, key), null ids first. Documents without tokens (null, empty, or punctuation only) are in no group;
    rows of equal id and text count as one document; rows of one id but other texts are documents of their own. An id
    that is no integer comes out as null. Very long texts are hashed whole. Ties go to the lesser key. An empty table
    gives an empty one; other columns, whatever their names, aren't read.
    """
    sigs = cut(signatures(docs), "signatures")
    pairs = cut(verified(star_edges(sigs), sigs, threshold), "pairs")
    found = components(pairs)
    members = found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct()
    named = members.join(sigs.select("doc_id", F.col("key").alias("node")).distinct(), "node")
    kept = named.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("k"), F.count(F.lit(1)).alias("group_size"))
    return named.join(kept, "root").select("doc_id", F.col("node").alias("key"), F.col("k.doc_id").alias("keep_id"), F.col("k.node").alias("keep_key"), "group_size")


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents of :func:`near_duplicates` that aren't kept; the columns stay as they are.

    Of rows with equal id and text one stays, if they have tokens; rows without tokens, null texts among them, all stay.
    The ids and keys to drop are broadcast if they are few, else joined by a shuffle. Columns of any names are passed on.
    """
    key, number = fresh(docs, "__key", "__id")
    none = F.lit(-(1 << 63))
    keyed = docs.withColumn(key, key_of()).withColumn(number, F.coalesce(F.col("doc_id").try_cast("long"), none))
    gone = cut(near_duplicates(docs, threshold).where("key != keep_key").select(F.col("key").alias(key), F.coalesce("doc_id", none).alias(number)).distinct(), "dropped")
    left = keyed.join(sized(gone), [key, number], "left_anti")
    again = cut(docs.select(key_of().alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "repeated")
    if again.count():
        lettered = F.coalesce(F.col("text").cast("string").rlike("[A-Za-z0-9]|[^\\x00-\\x7F]"), F.lit(False))
        twice = left.join(sized(again), key, "left_semi")
        left = left.join(sized(again), key, "left_anti").unionByName(twice.where(lettered).dropDuplicates([key])).unionByName(twice.where(~lettered))
    return left.select(*docs.columns)
