"""Find benchmark items in documents by a prefix-filtered set join on shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.minhash import key_of
from keyloom.llm.tokens import U, Chunk, chunks, mix, windows
from keyloom.plans.lineage import cut, sized
from keyloom.plans.names import fresh
from keyloom.plans.sizing import map_texts

#: Tokens of a shingle, and the least share of an item's shingles that a window of the item's size must hold.
SHINGLE_TOKENS = 3
CONTAINMENT = 0.6
#: Items, and bytes of their texts, that are broadcast at a time; a larger benchmark takes several passes over the documents.
ITEMS_PER_PASS, BYTES_PER_PASS = 200_000, 32 << 20


class Items:
    """Distinct shingles of benchmark items, in order of rarity, and the prefix that a match can't do without."""

    def __init__(self, item_ids: np.ndarray, sizes: np.ndarray, item_of: np.ndarray, shingles: np.ndarray, short: list[tuple[int, int, int]]):
        self.item_ids, self.sizes = item_ids, sizes
        self.item_of, self.shingles = item_of, shingles
        #: (tokens, hash of all of them, item) of the items with fewer tokens than a shingle.
        self.short = short

    @classmethod
    def read(cls, rows: pa.Table, n: int = SHINGLE_TOKENS) -> Items:
        ids, sizes, owner, hashes, short = [], [], [], [], []
        for chunk in chunks(rows.column("text")):
            h, doc, counts = shingles_of(chunk, n)
            ids.append(rows.column("item_id").to_numpy()[chunk.lo : chunk.hi])
            sizes.append(counts)
            owner.append(doc + chunk.lo)
            hashes.append(h)
            for k in range(1, n):
                whole, first = windows(chunk, k)
                doc = chunk.doc_of()[first]
                short += [(k, x, d + chunk.lo) for x, d in zip(whole.tolist(), doc.tolist()) if counts[d] == k]
        if not ids:
            return cls(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U), short)
        pair = np.unique(np.rec.fromarrays([np.concatenate(owner), np.concatenate(hashes)], names="owner,shingle"))
        return cls(np.concatenate(ids), np.concatenate(sizes), pair["owner"].copy(), pair["shingle"].copy(), short)

    def needed(self, containment: float) -> np.ndarray:
        """For each item, how many of its distinct shingles a match holds at least."""
        total = np.bincount(self.item_of, minlength=len(self.item_ids))
        return np.maximum(1, np.ceil(total * containment - 1e-9)).astype(np.int64)

    def order(self, shingles: np.ndarray, number: np.ndarray) -> None:
        """Sort each item's shingles from the rarest to the most frequent in the corpus, ties by hash.

        ``number`` has in how many documents each of the sorted ``shingles`` occurs; the others occur in none.
        """
        at = np.minimum(np.searchsorted(shingles, self.shingles), max(0, len(shingles) - 1))
        often = np.where(shingles[at] == self.shingles, number[at], 0) if len(shingles) else np.zeros(len(self.shingles), np.int64)
        by = np.lexsort((self.shingles, often, self.item_of))
        self.item_of, self.shingles = self.item_of[by], self.shingles[by]

    def prefixes(self, containment: float) -> np.ndarray:
        """A mask of the first total - needed + 1 shingles of each item: a match holds one of them at least."""
        total = np.bincount(self.item_of, minlength=len(self.item_ids))
        start = np.cumsum(total) - total
        rank = np.arange(len(self.item_of)) - start[self.item_of]
        return rank < (total - self.needed(containment) + 1)[self.item_of]


def shingles_of(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, tokens of each document) of the shingles of n tokens."""
    h, first = windows(chunk, n)
    return h, chunk.doc_of()[first], chunk.counts


class Filter:
    """Membership of hashes in a sorted set, through a bit table that most of them fail."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = max(12, min(24, int(len(self.values)).bit_length() + 6))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(self.values >> U(64 - self.bits)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where in ``hashes``, which value) of every member."""
        at = np.flatnonzero(self.table[(hashes >> U(64 - self.bits)).astype(np.int64)])
        if not len(self.values):
            return at[:0], at[:0]
        which = np.searchsorted(self.values, hashes[at])
        which[which == len(self.values)] = 0
        good = self.values[which] == hashes[at]
        return at[good], which[good]


def corpus_frequency(docs: DataFrame, items: Items, n: int = SHINGLE_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, documents): in how many documents each shingle of the benchmark occurs, none left out.

    Counted over all documents and summed in Spark; as many numbers come to the driver as the pass has shingles.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(Filter(items.shingles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.value.values), np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                h, doc, _ = shingles_of(chunk, n)
                at, which = known.value.find(h)
                pair = np.unique(doc[at] * len(total) + which) if len(at) else at
                total += np.bincount(pair % max(1, len(total)), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known.value.values[some].view(np.int64)), pa.array(total[some])], names=["shingle", "n"])

    counted = map_texts(docs.select("text"), run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()
    shingles = rows.column("shingle").to_numpy().view(U)
    by = np.argsort(shingles)
    return shingles[by], rows.column("n").to_numpy()[by]


class Index:
    """What a scan needs: prefix shingles and all shingles, as (shingle, item) sorted by shingle."""

    def __init__(self, items: Items, containment: float, n: int):
        self.items, self.n, self.needed = items, n, items.needed(containment)
        self.total = np.bincount(items.item_of, minlength=len(items.item_ids))
        self.total[[x[2] for x in items.short]] = 1
        self.all = Filter(items.shingles)
        prefix = items.prefixes(containment)
        self.is_prefix = np.zeros(len(self.all.values), bool)
        self.is_prefix[np.searchsorted(self.all.values, items.shingles[prefix])] = True
        self.by_prefix = self._pairs(prefix)
        self.by_any = self._pairs(np.ones(len(prefix), bool))
        self.short = {k: self._short([x for x in items.short if x[0] == k]) for k in sorted({x[0] for x in items.short})}

    def _short(self, rows: list[tuple[int, int, int]]) -> tuple[Filter, np.ndarray, np.ndarray]:
        """(hashes, where the items of each begin, items) of the items of one size."""
        hashes, owner = np.array([x[1] for x in rows], U), np.array([x[2] for x in rows], np.int64)
        known = Filter(hashes)
        which = np.searchsorted(known.values, hashes)
        by = np.argsort(which, kind="stable")
        return known, np.searchsorted(which[by], np.arange(len(known.values) + 1)), owner[by]

    def short_matches(self, chunk: Chunk) -> list[tuple[int, int, int, int]]:
        """The items of fewer tokens than a shingle, each at its first place in a document."""
        out = []
        for k, (known, start, items) in self.short.items():
            h, first = windows(chunk, k)
            doc = chunk.doc_of()[first]
            at, which = known.find(h)
            pair, once = np.unique(doc[at] * np.int64(len(known.values)) + which, return_index=True)
            for d, w, token in zip((pair // max(1, len(known.values))).tolist(), which[once].tolist(), (first[at[once]] - chunk.offsets[doc[at[once]]]).tolist()):
                out += [(d, i, 1, token) for i in items[start[w] : start[w + 1]].tolist()]
        return out

    def _pairs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        which = np.searchsorted(self.all.values, self.items.shingles[mask])
        by = np.argsort(which, kind="stable")
        return np.searchsorted(which[by], np.arange(len(self.all.values) + 1)), self.items.item_of[mask][by]

    def matches(self, chunk: Chunk) -> list[tuple[int, int, int, int]]:
        """(document, item, most shingles in a window, first token of that window) of the matches in a chunk."""
        found = self.short_matches(chunk)
        h, doc, counts = shingles_of(chunk, self.n)
        at, which = self.all.find(h)
        if not len(at):
            return found
        first = at - np.searchsorted(doc, doc[at])  # shingle i of a document starts at its token i
        sure = self.is_prefix[which]
        start, items = self.by_prefix
        lengths = (start[1:] - start[:-1])[which[sure]]
        pair_doc = np.repeat(doc[at][sure], lengths)
        pair_item = items[np.repeat(start[which[sure]], lengths) + _ranges(lengths)]
        pair_at = np.repeat(first[sure], lengths)
        # length bound: a document with fewer shingles than needed can't match
        enough = np.maximum(counts - self.n + 1, 1)[pair_doc] >= self.needed[pair_item]
        candidates: dict[tuple[int, int], list[int]] = {}
        for d, i, p in zip(pair_doc[enough].tolist(), pair_item[enough].tolist(), pair_at[enough].tolist()):
            candidates.setdefault((d, i), []).append(p)
        out = found
        bounds = np.searchsorted(doc[at], np.arange(chunk.hi - chunk.lo + 1))
        start, items = self.by_any
        for (d, i), places in candidates.items():
            lo, hi = bounds[d], bounds[d + 1]
            size = max(1, int(self.items.sizes[i]) - self.n + 1)  # shingles of a window of the item's size
            where, what = first[lo:hi], which[lo:hi]
            # positional bound: a window that holds a prefix shingle lies within its size of it
            near = np.zeros(hi - lo, bool)
            for p in places:
                a, b = np.searchsorted(where, (p - size + 1, p + size))
                near[a:b] = True
            mine = self.own(i)
            near &= np.isin(what, mine)
            best, token = _fullest(where[near], what[near], size)
            if best >= self.needed[i]:
                out.append((d, i, best, token))
        return out

    def own(self, i: int) -> np.ndarray:
        """The indexes of item i's shingles in ``all.values``."""
        if not hasattr(self, "_own"):
            cuts = np.searchsorted(self.items.item_of, np.arange(len(self.items.item_ids) + 1))
            self._own = (cuts, np.searchsorted(self.all.values, self.items.shingles))
        cuts, which = self._own
        return which[cuts[i] : cuts[i + 1]]


def _ranges(lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _fullest(where: np.ndarray, what: np.ndarray, size: int) -> tuple[int, int]:
    """The most distinct values of ``what`` at places within ``size`` of each other, and the first such place."""
    best, token, lo = 0, -1, 0
    held: dict[int, int] = {}
    places, values = where.tolist(), what.tolist()
    for hi, (p, v) in enumerate(zip(places, values)):
        held[v] = held.get(v, 0) + 1
        while places[lo] <= p - size:
            held[values[lo]] -= 1
            if not held[values[lo]]:
                del held[values[lo]]
            lo += 1
        if len(held) > best:
            best, token = len(held), places[lo]
    return best, token


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, n: int = SHINGLE_TOKENS, items_per_pass: int = ITEMS_PER_PASS, bytes_per_pass: int = BYTES_PER_PASS) -> DataFrame:
    """(doc_id, key, item_id, matched, needed, total, token): a row for each document and each item it contains.

    A document contains an item if some window of as many tokens as the item has holds at least ``containment`` of the
    item's distinct shingles of ``n`` tokens; ``token`` is where the fullest window starts. The shingles of each item
    are ordered by how many documents of the corpus have them. Only documents that hold one of the rarest
    total - needed + 1 can match (prefix filter); of those, documents that are too short (length bound) and places too
    far from a prefix shingle (positional bound) are left out, and the rest is counted exactly.

    An item of fewer than ``n`` tokens is contained where all of them stand in a row; it counts as one shingle.

    Two scans of the documents and no shuffle of texts. The items are broadcast, at most ``items_per_pass`` of them and
    ``bytes_per_pass`` of their texts at a time; a larger benchmark takes a pass for each part, with the same result.

    Null or empty texts on either side match nothing; very long ones are whole. Repeated rows and items of equal text give
    a row each. Ties go to the first fullest window, and in rarity to the lower hash. An id that is no integer counts as
    null, and null stays null. Empty tables give an empty one. Other columns aren't read. ``key`` tells rows of one doc_id apart.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), key_of().alias("key"), F.col("text").cast("string").alias("text"))
    wanted = benchmark.select(F.col("item_id").try_cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    number, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    parts = max(1, -(-number // items_per_pass), -(-size // bytes_per_pass))
    out = None
    for part in range(parts):
        mine = wanted if parts == 1 else wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        found = _one_pass(spark, keyed, mine, containment, n)
        out = found if out is None else out.unionByName(found)
    return out


SCHEMA = "doc_id long, key long, item_id long, matched int, needed int, total int, token int"


def _one_pass(spark, keyed: DataFrame, wanted: DataFrame, containment: float, n: int) -> DataFrame:
    rows = wanted.toArrow()
    rows = rows.set_column(0, "item_id", rows.column("item_id").fill_null(_NULL_ID))
    items = Items.read(rows, n)
    items.order(*corpus_frequency(keyed, items, n))
    index = spark.sparkContext.broadcast(Index(items, containment, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                found = known.matches(chunk)
                if found:
                    d, i, best, token = (np.array(x, np.int64) for x in zip(*found))
                    where = pa.array(d + chunk.lo)
                    ids = known.items.item_ids[i]
                    columns = [batch.column(0).take(where), batch.column(1).take(where), pa.array(ids, mask=ids == _NULL_ID), *(pa.array(x.astype(np.int32)) for x in (best, known.needed[i], known.total[i], token))]
                    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_texts(keyed, run, SCHEMA)


_NULL_ID = -(1 << 63)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that contain no item of ``benchmark``, by one more scan; the columns stay as they are.

    The ids and keys of contaminated documents are joined; Spark broadcasts them if they are few. Null texts and ids stay.
    """
    key, number = fresh(docs, "__key", "__id")
    none = F.lit(_NULL_ID)
    gone = cut(contaminated(docs, benchmark, **parameters).select(F.col("key").alias(key), F.coalesce("doc_id", none).alias(number)).distinct(), "contaminated")
    keyed = docs.withColumn(key, key_of()).withColumn(number, F.coalesce(F.col("doc_id").try_cast("long"), none))
    return keyed.join(sized(gone), [key, number], "left_anti").select(*docs.columns)
