"""Filter URLs by the likelihood ratio of character models of accepted and of rejected URLs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.decontaminate import Filter
from keyloom.llm.tokens import BASE, BASE_INV, U, mix, powers
from keyloom.plans.lineage import cut, drop

#: Where no labelled URLs are at hand: words in a host name that make its URLs examples of rejected ones; all other URLs
#: are examples of accepted ones.
REJECTED_WORDS = ("adult", "ads", "bet", "bets", "casino", "gambling", "loans", "pharma", "pills", "poker", "porn", "sex", "spam", "track", "viagra", "warez", "xxx")
#: Most characters of context.
ORDER = 5
#: A gram is kept if its class has it as often; at 1 none is dropped, and contexts have their whole totals and kinds.
MIN_COUNT = 1
#: Most grams whose models are broadcast; more are looked up by joins, with the same scores.
MAX_GRAMS = 1_000_000
#: One of this many hosts is held out of the models, to calibrate the threshold.
HELD_OUT = 5
#: Bins of score differences, per unit, in calibration.
BINS = 100
#: Bytes of URLs that are handled at a time.
CHUNK_BYTES = 1 << 20

SCHEMA = "page_id long, url string, n_chars int, score double"
_CLASSES = ("accepted", "rejected")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))


def example(url: Column, words: tuple[str, ...] = REJECTED_WORDS) -> Column:
    """1 for an example of rejected URLs, 0 for one of accepted ones, null for none."""
    bad = F.arrays_overlap(F.split(host(url), "[^a-z0-9]+"), F.array(*[F.lit(w) for w in words]))
    return F.when(F.length(url) > 0, bad.cast("int"))


def cleaned(url: Column) -> Column:
    """What the models read: lower case, without the scheme, every digit a 0."""
    return F.regexp_replace(F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.\-]*://", ""), r"\d", "0")


@dataclass
class Text:
    """The characters of some URLs; ``ends[i]`` is where URL i ends in ``places``, the indexes of the characters."""

    data: np.ndarray
    places: np.ndarray
    ends: np.ndarray
    sums: np.ndarray
    inverse: np.ndarray

    def hashes(self, k: int, last: bool) -> np.ndarray:
        """Of each character, its k predecessors, along with itself if ``last``."""
        lo, hi = self.places - k, self.places + last
        return mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + U(2 * k + last + 1))


def texts(urls: pa.Array) -> Iterator[tuple[int, int, Text]]:
    """(first, end, text) of stretches of a column; null counts as ''. An end mark is the last character of each URL."""
    urls = urls.cast(pa.large_string()).fill_null("")
    lengths = pc.binary_length(urls).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(lengths):
        return
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(lengths) // CHUNK_BYTES)) + 1).tolist(), len(lengths)]
    pad = pa.scalar("\x01" * ORDER, pa.large_string())
    for lo, hi in zip(cuts, cuts[1:]):
        part = pc.binary_join_element_wise(pad, urls.slice(lo, hi - lo), pa.scalar("\x02", pa.large_string()), pa.scalar("", pa.large_string()))
        bounds = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        real = np.ones(len(data), bool)
        real[(bounds[:-1] - bounds[0])[:, None] + np.arange(ORDER)] = False
        sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * powers(BASE, len(data)), out=sums[1:])
        yield lo, hi, Text(data, np.flatnonzero(real), np.cumsum(lengths[lo:hi] + 1), sums, powers(BASE_INV, len(data) + 1))


def gram_counts(pages: DataFrame) -> DataFrame:
    """(gram, context, k, accepted, rejected): how often each character follows each context of k characters.

    ``pages`` has ``text`` and ``kind`` (1 rejected, 0 accepted). Every URL counts; tasks sum their own before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            for lo, hi, text in texts(batch.column(0)):
                kind = np.repeat(kinds[lo:hi], np.diff(text.ends, prepend=0))
                for k in range(ORDER + 1):
                    held.append(summed(text.hashes(k, True), text.hashes(k, False), np.full(len(kind), k), kind == 0, kind == 1))
                    size += len(held[-1][0])
                if size > 1 << 20:
                    held = [summed(*(np.concatenate(x) for x in zip(*held)))]
                    size = 0
        if held:
            gram, context, k, good, bad = summed(*(np.concatenate(x) for x in zip(*held)))
            for lo in range(0, len(gram), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(gram[part].view(np.int64)), pa.array(context[part].view(np.int64)), pa.array(k[part].astype(np.int32)), pa.array(good[part]), pa.array(bad[part])], names=["gram", "context", "k", *_CLASSES])

    counted = pages.select("text", "kind").mapInArrow(run, "gram long, context long, k int, accepted long, rejected long")
    return counted.groupBy("gram", "context", "k").agg(*[F.sum(c).alias(c) for c in _CLASSES])


def summed(gram: np.ndarray, context: np.ndarray, k: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[np.ndarray]:
    some, first, which = np.unique(gram, return_index=True, return_inverse=True)
    return [some, context[first], k[first], *(np.bincount(which, x, len(some)).astype(np.int64) for x in (good, bad))]


class Model:
    """A variable-order Markov model, each order interpolated with the next lower one by Witten and Bell's weights."""

    def __init__(self, gram: np.ndarray, context: np.ndarray, n: np.ndarray):
        self.grams = Filter(gram)
        self.n = np.zeros(len(self.grams.values))
        self.n[np.searchsorted(self.grams.values, gram)] = n
        self.contexts = Filter(context)
        which = np.searchsorted(self.contexts.values, context)
        self.total = np.bincount(which, n, len(self.contexts.values)).astype(float)
        self.kinds = np.bincount(which, minlength=len(self.contexts.values)).astype(float)

    def log_likelihood(self, text: Text) -> np.ndarray:
        """Of each character, the logarithm of its probability after its predecessors; 1/256 where nothing is known."""
        p = np.full(len(text.places), 1 / 256)
        for k in range(ORDER + 1):
            at, which = self.contexts.find(text.hashes(k, False))
            n = np.zeros(len(p))
            there, gram = self.grams.find(text.hashes(k, True))
            n[there] = self.n[gram]
            p[at] = (n[at] + self.kinds[which] * p[at]) / (self.total[which] + self.kinds[which])
        return np.log(p)


def gram_table(pages: DataFrame) -> DataFrame:
    """The rows of :func:`gram_counts` that a class has at least MIN_COUNT times; lower counts of the other class are 0."""
    some = [F.when(F.col(c) >= MIN_COUNT, F.col(c)).otherwise(F.lit(0)).cast("long").alias(c) for c in _CLASSES]
    return gram_counts(pages).select("gram", "context", "k", *some).where(" or ".join(f"{c} > 0" for c in _CLASSES))


def models_of(grams: DataFrame) -> tuple[Model, Model]:
    """The models of both classes, on the driver, from the rows of :func:`gram_table`."""
    table = grams.toArrow()
    gram, context = (table.column(c).to_numpy().astype(np.int64).view(U) for c in ("gram", "context"))
    models = []
    for name in _CLASSES:
        n = table.column(name).to_numpy()
        some = n > 0
        models.append(Model(gram[some], context[some], n[some]))
    return models[0], models[1]


def train(pages: DataFrame) -> tuple[Model, Model]:
    """The models of accepted and of rejected URLs in ``pages`` (text, kind)."""
    return models_of(gram_table(pages))


def score(pages: DataFrame, models: tuple[Model, Model]) -> DataFrame:
    """(page_id, url, n_chars, score): the log-likelihood of the rejected model less that of the accepted one, a character."""
    known = pages.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = known.value
        for batch in batches:
            for lo, hi, text in texts(batch.column(2)):
                sums = np.append(0, np.cumsum(bad.log_likelihood(text) - good.log_likelihood(text)))
                size = np.diff(text.ends, prepend=0)
                per = np.diff(sums[text.ends], prepend=0.0) / size
                here = [batch.column(k).slice(lo, hi - lo) for k in range(2)]
                missing = size == 1
                yield pa.RecordBatch.from_arrays([*here, pa.array((size - 1).astype(np.int32)), pa.array(per, mask=missing)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return pages.select(F.col("page_id").try_cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), cleaned(F.col("url").cast("string")).alias("text")).mapInArrow(run, SCHEMA)


def score_by_join(pages: DataFrame, grams: DataFrame) -> DataFrame:
    """As :func:`score`, by joins with the rows of :func:`gram_table`, for models too large to broadcast.

    A character's probability follows from it and its ORDER predecessors, so each distinct window of these is looked up once.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, hi, text in texts(batch.column(1)):
                key = np.repeat(keys[lo:hi], np.diff(text.ends, prepend=0))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(text.hashes(ORDER, True).view(np.int64))], names=["key", "window"])

    def lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, text in texts(batch.column(1)):
                window, first = np.unique(text.hashes(ORDER, True), return_index=True)
                for k in range(ORDER + 1):
                    columns = (window, text.hashes(k, True)[first], text.hashes(k, False)[first])
                    yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in columns), pa.array(np.full(len(window), k, np.int32))], names=["window", "gram", "context", "k"])

    named = pages.select(F.col("page_id").try_cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), cleaned(F.col("url").cast("string")).alias("text"))
    named = named.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    distinct = named.where("text != ''").groupBy("key").agg(F.min("text").alias("text"))
    contexts = grams.groupBy("context").agg(*[x for c in _CLASSES for x in (F.sum(c).alias(f"{c}_total"), F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds"))])
    found = distinct.mapInArrow(lookups, "window long, gram long, context long, k int").dropDuplicates(["window", "k"])
    found = found.join(grams.select("gram", *_CLASSES), "gram", "left").join(contexts, "context", "left")
    parts = [(c, k, x) for c in _CLASSES for k in range(ORDER + 1) for x in ("", "_total", "_kinds")]
    wide = found.groupBy("window").agg(*[F.max(F.when(F.col("k") == k, F.col(c + x))).alias(f"{c}{x}{k}") for c, k, x in parts])
    logs = []
    for c in _CLASSES:
        p = F.lit(1 / 256)
        for k in range(ORDER + 1):
            n, total, kinds = (F.coalesce(F.col(f"{c}{x}{k}"), F.lit(0)) for x in ("", "_total", "_kinds"))
            # an unknown context leaves p as it is
            kinds = F.when(total > 0, kinds).otherwise(F.lit(1))
            p = (n + kinds * p) / (total + kinds)
        logs.append(F.log(p))
    ratios = wide.select("window", (logs[1] - logs[0]).alias("ratio"))
    per = distinct.mapInArrow(places, "key long, window long").join(ratios, "window").groupBy("key").agg(F.avg("ratio").alias("score"))
    return named.join(cut(per, "scores"), "key", "left").select("page_id", "url", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_chars"), "score")


def calibrate(scored: DataFrame) -> float:
    """The threshold that best separates the scores of the two kinds: the highest sum of both rates that are right.

    Scores are counted in bins by Spark; a score is a mean of log-probabilities, of which none is below the logarithm of
    1/256 over the product of ORDER + 1 counts, so that bins are some ten thousand at most. Among equally good
    thresholds, the middle one is taken, and 0 if a kind is missing.
    """
    rows = scored.where("score is not null").groupBy("kind", F.floor(F.col("score") * BINS).alias("bin")).count().collect()
    if len({r.kind for r in rows}) < 2:
        return 0.0
    bins, at = np.unique([r.bin for r in rows], return_inverse=True)
    counts = np.zeros((2, len(bins)))
    counts[[r.kind for r in rows], at] = [r["count"] for r in rows]
    rates = np.cumsum(counts, axis=1) / counts.sum(axis=1, keepdims=True)
    good = rates[0] - rates[1]  # of accepted below the end of a bin, less of rejected below it; bins without scores change nothing
    first = last = int(np.flatnonzero(good >= good.max() - 1e-12)[0])
    while last + 1 < len(bins) and good[last + 1] >= good.max() - 1e-12:
        last += 1
    end = bins[last + 1] - 1 if last + 1 < len(bins) else bins[last]
    return float((bins[first] + end) / 2 + 1) / BINS


def word_examples(pages: DataFrame, words: tuple[str, ...] = REJECTED_WORDS) -> DataFrame:
    """(url, rejected): every URL of ``pages``, labelled by :func:`example`, for want of labels."""
    url = F.col("url").cast("string")
    return pages.select(url.alias("url"), example(url, words).alias("rejected"))


def url_filter(pages: DataFrame, examples: DataFrame) -> DataFrame:
    """(page_id, url, n_chars, score, rejected): every page, and whether its URL is rejected.

    ``examples`` has (url, rejected), labelled URLs: 1 or true for a rejected one, 0 or false for an accepted one; rows
    without a URL or a label are none. The models count the characters of the examples of all hosts but one in HELD_OUT (by
    hash); counts are summed by Spark, and none is dropped. Up to MAX_GRAMS grams are broadcast, more are joined. The
    examples of held-out hosts calibrate the threshold. Other columns, texts included, aren't read.

    Null and empty URLs have no score and aren't rejected; very long ones are read whole; a score that ties with the
    threshold is rejected; repeated rows give repeated rows; a null id stays null, and one that is no integer becomes
    null. Without examples of a kind, its model gives every character 1/256 and the threshold is 0. Empty tables give an
    empty one.
    """
    url = F.col("url").cast("string")
    seen = examples.select(url.alias("url"), F.col("rejected").cast("int").cast("long").alias("page_id"), F.pmod(F.xxhash64(host(url)), F.lit(HELD_OUT)).alias("part")).where("page_id is not null and url != ''")
    grams = cut(gram_table(seen.where("part != 0").select(cleaned(F.col("url")).alias("text"), F.col("page_id").cast("int").alias("kind"))), "grams")
    held = seen.where("part = 0")
    if grams.count() <= MAX_GRAMS:
        models = models_of(grams)
        scored, known = score(pages, models), score(held, models)
        drop(grams)
    else:
        scored, known = score_by_join(pages, grams), score_by_join(held, grams)
    threshold = calibrate(known.select(F.col("page_id").cast("int").alias("kind"), "score"))
    return scored.withColumn("rejected", F.coalesce(F.col("score") >= threshold, F.lit(False)))
