"""Find token windows that occur more than once in the corpus, and merge them into intervals to remove."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.minhash import key_of
from keyloom.llm.tokens import U, chunks, mix, partitions, total_bytes, windows
from keyloom.plans.lineage import cut, drop
from keyloom.plans.names import fresh
from keyloom.plans.sizing import map_texts

#: Tokens of a window.
WINDOW_TOKENS = 50
#: Tokens of the shingles of which the least of a window chooses its bucket.
MINIMIZER_TOKENS = 4
#: Bytes of input for one bucket; the number of buckets follows the size of the input.
BUCKET_BYTES = 1 << 18
#: Chunks (of half a MB of text) in which a task looks for repeats before it sends windows on.
FLUSH = 16
#: Windows that are counted at a time, in whole buckets.
COUNT_WINDOWS = 1 << 20
#: A bucket of more windows is split by the windows' own hashes into buckets of about COUNT_WINDOWS.
MOST_WINDOWS = 4 << 20
#: Bytes that a window takes in the shuffle.
WINDOW_BYTES = 9

#: A run is a row of consecutive windows of a document. Of each run: id, key, first token, windows and state (SOLE,
#: FIRST or AGAIN among the windows of its task); then the hashes of all windows but the AGAIN ones.
_ROWS = "bucket long, ids binary, keys binary, starts binary, lengths binary, states binary, hashes binary"
_RUNS = "doc_id long, key long, start int, length int, again boolean"
SCHEMA = "doc_id long, key long, start int, end int, removed boolean"
SOLE, FIRST, AGAIN = 0, 1, 2
_NULL_ID = -(1 << 63)


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours."""
    width = 1
    while width * 2 <= n:
        x, width = np.minimum(x[:-width], x[width:]), width * 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def _binary(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The slices of ``flat`` between ``bounds``, as binary values."""
    flat = np.ascontiguousarray(flat)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])


def _breaks(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(out)


def buckets_of(chunk, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, bucket, first token) of every window of a chunk; the bucket is that of its least shingle."""
    h, first = windows(chunk, n)
    if not len(h):
        return h, np.empty(0, np.int64), first
    m = min(MINIMIZER_TOKENS, n)
    g = chunk.hashes
    for k in range(1, m):
        g = mix(g[:-1] + U(k)) ^ chunk.hashes[k:]
    return h, (mix(sliding_least(mix(g), n - m + 1))[first] % U(buckets)).astype(np.int64), first


class Sender:
    """The windows of some documents, to be sent to their buckets; ``hot`` has the buckets to split, in how many each."""

    def __init__(self, n: int, buckets: int, hot: tuple[np.ndarray, np.ndarray] | None = None):
        self.n, self.buckets = n, U(buckets)
        self.hot = hot if hot is not None else (np.empty(0, np.int64), np.empty(0, np.int64))
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, chunk, ids: np.ndarray, keys: np.ndarray) -> None:
        h, bucket, first = buckets_of(chunk, self.n, int(self.buckets))
        if not len(h):
            return
        which, into = self.hot
        if len(which):
            at = np.minimum(np.searchsorted(which, bucket), len(which) - 1)
            split = which[at] == bucket
            # beyond all other buckets, by the bucket and the hash of the window
            own = (mix(h[split] ^ U(1)) % into[at[split]].astype(U)).astype(np.int64)
            start = np.cumsum(into) - into
            bucket[split] = int(self.buckets) + 1024 + start[at[split]] + own
        doc = chunk.doc_of()[first]
        self.parts.append((h, bucket, ids[doc], keys[doc], (first - chunk.offsets[doc]).astype(np.int32)))

    def rows(self) -> pa.RecordBatch | None:
        """One row a bucket. Of windows that are equal here, only the first is sent to be counted."""
        if not self.parts:
            return None
        h, bucket, ids, keys, at = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        state = np.zeros(len(h), np.int8)
        order = np.argsort(h, kind="stable")
        equal = h[order][1:] == h[order][:-1]
        many = np.zeros(len(h), bool)
        many[order[1:][equal]] = many[order[:-1][equal]] = True
        some = np.flatnonzero(many)
        if len(some):
            some = some[np.lexsort((at[some], keys[some], ids[some], h[some]))]
            group = np.zeros(len(some), bool)
            group[_breaks(h[some])] = True
            place = np.zeros(len(some), bool)
            place[_breaks(h[some], keys[some], at[some])] = True
            state[some] = np.where(group, FIRST, AGAIN)
            state[some[~place]] = -1  # a row that occurs again
            # a first window whose equals are all the same row is the only one
            number = np.bincount(np.cumsum(group) - 1, place)
            state[some[group][number == 1]] = SOLE
        use = np.flatnonzero(state >= 0)
        h, bucket, ids, keys, at, state = (x[use] for x in (h, bucket, ids, keys, at, state))
        # windows that are known to occur again need no counting; they go along in buckets of their own
        bucket = np.where(state == AGAIN, np.int64(self.buckets) + (keys & 1023), bucket)
        start = _breaks(keys, ids, bucket, state, at - np.arange(len(at)))
        length = np.diff(np.append(start, len(at))).astype(np.int32)
        by = np.argsort(bucket[start], kind="stable")
        start, length = start[by], length[by]
        counted = np.where(state[start] == AGAIN, 0, length)
        offset = np.cumsum(counted) - counted
        sent = h[np.repeat(start - offset, counted) + np.arange(counted.sum())]
        cuts = np.append(_breaks(bucket[start]), len(start))
        ends = np.append(offset, counted.sum())[cuts]
        columns = [pa.array(bucket[start[cuts[:-1]]]), *(_binary(x, cuts) for x in (ids[start], keys[start], at[start], length, state[start])), _binary(sent, ends)]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _ROWS.split(", ")])


def count(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, key, start, length, again) of the runs of windows that occur more than once among whole buckets."""
    known = np.flatnonzero(states == AGAIN)
    out = [(ids[known], keys[known], starts[known], lengths[known], np.ones(len(known), bool))]
    runs = np.flatnonzero(states != AGAIN)
    size = lengths[runs].astype(np.int64)
    run = np.repeat(runs, size)
    at = starts[run] + (np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
    order = np.argsort(hashes, kind="stable")
    equal = hashes[order][1:] == hashes[order][:-1]
    many = states[run] == FIRST
    many[order[1:][equal]] = many[order[:-1][equal]] = True
    w = np.flatnonzero(many)
    if len(w):
        w = w[np.lexsort((at[w], keys[run[w]], ids[run[w]], hashes[w]))]
        new = np.zeros(len(w), bool)
        new[_breaks(hashes[w])] = True
        group = np.cumsum(new) - 1
        place = np.zeros(len(w), bool)
        place[_breaks(hashes[w], keys[run[w]], at[w])] = True  # else a row that occurs again
        repeated = (np.bincount(group, place) > 1) | (np.bincount(group, states[run[w]] == FIRST) > 0)
        use = place & repeated[group]
        w, again = w[use], ~new[use]
        by = np.lexsort((at[w], again, keys[run[w]], ids[run[w]]))
        w, again = w[by], again[by]
        doc, key, place = ids[run[w]], keys[run[w]], at[w]
        first = _breaks(doc, key, again, place - np.arange(len(place)))
        out.append((doc[first], key[first], place[first], np.diff(np.append(first, len(place))).astype(np.int32), again[first]))
    return tuple(np.concatenate(x) for x in zip(*out))


def intervals(doc: np.ndarray, start: np.ndarray, length: np.ndarray, again: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(document, start, end, removed) from runs of windows of n tokens.

    What first occurrences cover stays; what only later ones cover is removed. Intervals of either kind are as long as
    they can be, and don't overlap.
    """
    place = np.concatenate([start, start + length + (n - 1)]).astype(np.int64)
    step = np.concatenate([np.ones(len(start), np.int64), -np.ones(len(start), np.int64)])
    who, later = np.concatenate([doc, doc]), np.concatenate([again, again])
    by = np.lexsort((place, who))
    who, place, step, later = who[by], place[by], step[by], later[by]
    firsts, agains = np.cumsum(np.where(later, 0, step)), np.cumsum(np.where(later, step, 0))
    last = np.append(_breaks(who, place)[1:] - 1, len(who) - 1)
    who, place, kind = who[last], place[last], np.where(firsts[last] > 0, 1, np.where(agains[last] > 0, 2, 0))
    head = _breaks(who, kind)
    end = np.append(place[head[1:]], 0)
    real = kind[head] > 0
    return who[head][real], place[head][real], end[real], kind[head][real] == 2


def bucket_sizes(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, n): how many windows of the column ``text`` are in each bucket; tasks sum their own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                held.append(np.unique(buckets_of(chunk, n, buckets)[1], return_counts=True))
                if len(held) > FLUSH:
                    yield summed(held)
                    held = []
        if held:
            yield summed(held)

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        some, which = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        number = np.bincount(which, np.concatenate([x[1] for x in held]), len(some)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array(number)], names=["bucket", "n"])

    return map_texts(texts.select("text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def repeats(docs: DataFrame, n: int = WINDOW_TOKENS, bucket_bytes: int = BUCKET_BYTES, most_windows: int = MOST_WINDOWS, count_windows: int = COUNT_WINDOWS) -> DataFrame:
    """(doc_id, key, start, end, removed): intervals of tokens that lie in windows which occur more than once.

    Every window of ``n`` tokens is hashed (Rabin-Karp) and counted. Of equal windows, the one of the least (doc_id, key,
    token) is the first. The tokens of first windows stay (``removed`` is false); those that only later ones cover are
    to be removed. Windows of one document count as well as those of several.

    Windows go to the bucket of their least shingle, which neighbours mostly share, so that a run of windows travels as
    one row: about nine bytes a window are shuffled, once. Windows that are equal within a task are counted there,
    so a passage of the whole corpus sends one window a task to its bucket. The numbers of buckets and of tasks follow
    the size of the input, and a task counts a few whole buckets at a time. A first scan counts the windows of each
    bucket: one of more than ``most_windows``, whose shingle the corpus is full of, is split by the windows' own hashes.
    What is found goes to its document by a second, smaller shuffle.

    Null, empty and short texts have no window; very long texts are whole. Rows of equal id and text count as one
    document; ``key`` tells rows of one id apart. An id that is no integer counts as null, which comes before others. An
    empty table gives an empty one; other columns aren't read.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), key_of().alias("key"), F.col("text").cast("string").alias("text"))
    buckets = max(64, min(1 << 40, total_bytes(docs, "text") // bucket_bytes))
    sizes = cut(bucket_sizes(keyed, n, buckets), "buckets")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # at most total / most_windows rows
    hot = sizes.where(F.col("n") > most_windows).toArrow().sort_by("bucket")
    drop(sizes)
    split = spark.sparkContext.broadcast((hot.column("bucket").to_numpy(), -(-hot.column("n").to_numpy() // count_windows)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(n, buckets, split.value)
        for batch in batches:
            ids, keys = batch.column(0).fill_null(_NULL_ID).to_numpy(), batch.column(1).to_numpy()
            for chunk in chunks(batch.column(2)):
                sender.add(chunk, ids[chunk.lo : chunk.hi], keys[chunk.lo : chunk.hi])
                if len(sender.parts) >= FLUSH:
                    yield sender.rows()
        if sender.parts:
            yield sender.rows()

    kinds = (np.int64, np.int64, np.int32, np.int32, np.int8, U)

    def counted(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        ids, *rest = count(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == _NULL_ID), *map(pa.array, rest)], names=[x.split()[0] for x in _RUNS.split(", ")])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            start = _breaks(bucket) if len(bucket) else np.empty(0, np.int64)
            for lo, hi in zip(start, np.append(start[1:], len(bucket))):
                if size >= count_windows and bucket[lo] != last:
                    yield counted(held)
                    held, size = [], 0
                last = bucket[lo]
                part = [_flat(batch.column(k + 1).slice(lo, hi - lo), kind) for k, kind in enumerate(kinds)]
                size += len(part[5]) + len(part[0])
                held.append(part)
        if held:
            yield counted(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            number = pc.list_value_length(lists).to_numpy()
            flat = lists.flatten()
            which, start, end, removed = intervals(np.repeat(np.arange(len(number)), number), *(flat.field(k).to_numpy(zero_copy_only=False) for k in range(3)), n)
            where = pa.array(which)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(removed)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    sent = map_texts(keyed, send, _ROWS).repartition(partitions(spark, WINDOW_BYTES * total), "bucket").sortWithinPartitions("bucket")
    runs = sent.mapInArrow(receive, _RUNS)
    return runs.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "length", "again")).alias("runs")).mapInArrow(merge, SCHEMA)


def _flat(values: pa.Array, kind: type) -> np.ndarray:
    """The numbers in neighbouring binary values."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].copy().view(kind)


def without_repeats(docs: DataFrame, n: int = WINDOW_TOKENS) -> DataFrame:
    """``docs`` with the intervals to remove cut out of their texts; the columns stay as they are.

    What lies between the first removed token and the next one that stays is cut. The intervals are joined by key. Rows
    without a text, or with nothing to cut, stay as they are; columns of any names are passed on.
    """
    key, cuts = fresh(docs, "__key", "__cuts")
    gone = repeats(docs, n).where("removed").groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cuts))
    joined = docs.withColumn(key, key_of()).join(gone, key, "left").select(*docs.columns, cuts)
    names, at, width = docs.columns, docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(at), batch.column(width)
            some = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            columns = [batch.column(k) for k in range(width)]
            if len(some):
                new = texts.to_pylist()
                for chunk in chunks(texts.take(pa.array(some)), lower=False):
                    for d in range(chunk.lo, chunk.hi):
                        a, b = chunk.offsets[d - chunk.lo], chunk.offsets[d - chunk.lo + 1]
                        raw = new[some[d]].encode()
                        base = chunk.bounds[d - chunk.lo]
                        starts = chunk.starts[a:b] - base
                        kept, here = [], 0
                        for cut in lists[int(some[d])].as_py():
                            kept.append(raw[here : starts[cut["start"]]])
                            here = starts[cut["end"]] if cut["end"] < len(starts) else len(raw)
                        new[some[d]] = b"".join([*kept, raw[here:]]).decode("utf-8", "replace")
                columns[at] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_texts(joined, run, docs.schema)
