"""Induce a toxicity lexicon by random walks over a word graph, and score documents with it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm import wordgraph
from keyloom.llm.decontaminate import Filter
from keyloom.llm.tokens import Chunk, U, chunks, hash_words, mix, unmix, windows
from keyloom.llm.wordgraph import signed_root_column
from keyloom.plans.lineage import cut, drop, sized
from keyloom.plans.names import fresh
from keyloom.plans.sizing import map_texts

#: Most labelled documents whose terms choose the seeds.
MAX_LABELLED = 50_000
#: Whole tokens are terms; those of different languages are different terms, and each language is a graph of its own.
#: Terms in at least NODE_COUNT documents, and in at most NODE_SHARE of those of their language, are nodes; more frequent
#: ones are stop terms. The least count doesn't rise with the corpus.
NODE_COUNT, NODE_SHARE = 3, 0.2
#: The language of documents without one.
NO_LANGUAGE = 0
#: A toxic seed is more frequent in toxic than in clean labelled documents by a likelihood ratio whose signed root is at
#: least MIN_ROOT. Clean seeds are the terms of clean labelled documents that are at most as frequent in toxic ones.
MIN_ROOT = 4.0
#: Tokens and number of the shingle minima that tell contents apart.
SKETCH_TOKENS, SKETCHES = 4, 4
#: Terms with at least this polarity are in the lexicon, unless fewer than MIN_SHARE of their labelled documents are
#: toxic, where the walk counts as PRIOR documents: too few to outvote a single clean one. That share times the polarity is a
#: term's weight.
MIN_POLARITY, MIN_SHARE, PRIOR = 0.5, 0.3, 0.4
#: A document is toxic if the weights of its terms sum to as much, and are as large a share of its tokens.
MIN_SCORE, MIN_RATE = 1.0, 0.006
#: Chunks whose counts a task sums up at a time, and the most distinct terms that it holds before it sends them.
FLUSH, MOST_TERMS = 16, 300_000

_COUNTS = "term long, code long, n long, uses long, toxic long, clean long"
_LABELLED = "key long, code long, toxic int"


@dataclass
class Lexicon:
    """Terms with their languages; ``term`` is a hash of both."""

    term: np.ndarray
    code: np.ndarray
    polarity: np.ndarray
    share: np.ndarray

    @property
    def weight(self) -> np.ndarray:
        return self.polarity * self.share

    @property
    def hashes(self) -> np.ndarray:
        """The hashes of the terms' tokens, as :func:`tokens.hash_words` has them."""
        return unmix(self.term) ^ self.code.view(U)

    def words(self, candidates: list[str]) -> set[str]:
        """Those of ``candidates`` that are terms in some language."""
        known = set(self.hashes.tolist())
        return {w for w, h in zip(candidates, hash_words(candidates).tolist()) if h in known}


def _code(docs: DataFrame) -> Column:
    """A hash of the language; NO_LANGUAGE for null, '' and a table without languages."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    return F.when(lang == "", F.lit(NO_LANGUAGE).cast("long")).otherwise(F.xxhash64(lang))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, code, text); ``key`` tells rows of one id apart. An id that is no integer counts as null."""
    doc_id, text = F.col("doc_id").try_cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(F.col("doc_id").cast("string"), text).alias("key"), _code(docs).alias("code"), text.alias("text"))


def terms(texts: pa.Array, codes: pa.Array) -> Iterator[tuple[Chunk, Chunk]]:
    """(tokens, terms) of each chunk of a column of texts with their languages."""
    codes = codes.to_numpy().view(U)
    for chunk in chunks(texts):
        yield chunk, replace(chunk, hashes=mix(chunk.hashes ^ np.repeat(codes[chunk.lo : chunk.hi], chunk.counts)))


def sketches(chunk: Chunk, number: int = SKETCHES) -> np.ndarray:
    """For each document, the least hash of its shingles under each of ``number`` hash functions; 0 without shingles."""
    h, first = windows(chunk, SKETCH_TOKENS)
    out = np.zeros((chunk.hi - chunk.lo, number), U)
    doc = chunk.doc_of()[first]
    if len(doc):
        start = np.flatnonzero(np.diff(doc, prepend=-1))
        for k in range(number):
            out[doc[start], k] = np.minimum.reduceat(mix(h ^ U(k)), start)
    return out


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> pa.Table:
    """(key, code, toxic) of the labelled documents that choose the seeds.

    At most ``max_labelled`` labels are used, those of the least hashed ids; a row without an id or a label is none, and
    of several labels of an id the toxic one holds. Of documents that share a shingle minimum, as copies do, the one
    of the least key stays, lest the words of a document that was copied a thousand times become seeds; so one of
    repeated rows stays, and texts without a shingle all do. Without labels the table is empty.
    """
    some = labels.where(F.col("doc_id").try_cast("long").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").try_cast("long").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = F.broadcast(some.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled))
    joined = _keyed(docs).join(some, F.col("doc_id") == F.col("__id")).select("key", "code", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(3)):
                part = slice(chunk.lo, chunk.hi)
                s = sketches(chunk).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(k)[part] for k in range(3)] + [pa.array(s[:, k]) for k in range(SKETCHES)], names=["key", "code", "toxic", *(f"s{k}" for k in range(SKETCHES))])

    rows = map_texts(joined, run, _LABELLED + "".join(f", s{k} long" for k in range(SKETCHES))).toArrow().sort_by("key")
    fresh = np.ones(rows.num_rows, bool)
    for k in range(SKETCHES):
        s = rows.column(f"s{k}").to_numpy()
        first = np.zeros(len(s), bool)
        first[np.unique(s, return_index=True)[1]] = True
        fresh &= first | (s == 0)
    return rows.select(["key", "code", "toxic"]).filter(pa.array(fresh))


def word_counts(docs: DataFrame, sample: pa.Table) -> DataFrame:
    """(term, code, n, uses, toxic, clean): in how many documents, toxic and clean ones of the sample each term occurs.

    ``uses`` counts its tokens. Every document counts. Tasks sum the counts of their own documents before the shuffle.
    """
    known = docs.sparkSession.sparkContext.broadcast((sample.column("key").to_numpy(), sample.column("toxic").to_numpy()))

    def counted(chunk: Chunk, codes: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, ...]:
        term, first, which, uses = np.unique(chunk.hashes, return_index=True, return_inverse=True, return_counts=True)
        doc_of, size = chunk.doc_of(), max(1, len(term))
        pair = np.sort(doc_of * size + which)
        pair = pair[np.flatnonzero(np.diff(pair, prepend=-1))]
        doc, word = pair // size, pair % size
        kind = toxic[doc]
        return term, codes[doc_of[first]], np.bincount(word, minlength=len(term)), uses, *(np.bincount(word[kind == k], minlength=len(term)) for k in (1, 0))

    def summed(held: list) -> tuple[np.ndarray, ...]:
        term, first, which = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
        return term, np.concatenate([x[1] for x in held])[first], *(np.bincount(which, np.concatenate([x[k] for x in held]), len(term)).astype(np.int64) for k in (2, 3, 4, 5))

    def sent(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(columns[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)].view(np.int64)) for x in columns], names=[x.split()[0] for x in _COUNTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, labels = known.value
        held: list = []
        for batch in batches:
            mine, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
            toxic = np.where(keys[at] == mine, labels[at], -1) if len(keys) else np.full(len(mine), -1)
            for _, chunk in terms(batch.column(2), batch.column(1)):
                part = slice(chunk.lo, chunk.hi)
                held.append(counted(chunk, codes[part], toxic[part]))
                if len(held) > FLUSH:
                    held = [summed(held)]
                    if len(held[0][0]) > MOST_TERMS:
                        yield from sent(*held.pop())
        if held:
            yield from sent(*summed(held))

    return map_texts(_keyed(docs).select("key", "code", "text"), run, _COUNTS).groupBy("term", "code").agg(*[F.sum(c).alias(c) for c in ("n", "uses", "toxic", "clean")])


def _languages(docs: DataFrame, sample: pa.Table) -> DataFrame:
    """(code, docs, toxic_docs, clean_docs), counted over all documents and over the sample."""
    spark = docs.sparkSession
    marks = spark.createDataFrame(sample.select(["code", "toxic"])).groupBy("code").agg(F.sum("toxic").alias("toxic_docs"), F.sum(1 - F.col("toxic")).alias("clean_docs"))
    return docs.select(_code(docs).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("docs")).join(marks, "code", "left").fillna(0)


def polarities(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, ranked: int = wordgraph.RANKED) -> DataFrame:
    """(term, code, n, toxic, clean, is_seed, polarity, share): the nodes that a walk visits, from -1 (clean) to 1 (toxic).

    The graph joins all nodes of a language that meet (see :mod:`wordgraph`), by positive pointwise mutual information over
    all documents. One walk restarts at the toxic seeds, alike often at each, one at the clean ones; a term's polarity compares how
    often they visit it, and ``share`` is what the labelled documents say of it. All seeds count, all nodes are counted,
    and neither is brought to the driver. A language without toxic seeds has no walk; without labels there is no row.

    Null, empty and wordless texts have no terms. Very long texts are whole documents like others. Repeated rows count each.
    Rows of equal text but one give no seeds. Ties can't occur: every rule is a threshold. Extra columns aren't read.
    """
    sample = labelled(docs, labels, max_labelled)
    languages = cut(_languages(docs, sample), "languages")
    high = F.greatest(F.lit(float(NODE_COUNT)), NODE_SHARE * F.col("docs"))
    counted = cut(word_counts(docs, sample).join(sized(languages), "code").withColumn("stop", F.col("n") > high), "terms")
    # at most mean distinct terms of a document / NODE_SHARE a language
    stop = counted.where("stop").select("term").toArrow().column("term").to_numpy().view(U)
    totals = counted.where("not stop").groupBy("code").agg(F.sum("uses").alias("total"))
    seen = totals.agg(F.sum("total")).first()[0] or 0
    nodes = counted.where((~F.col("stop")) & (F.col("n") >= NODE_COUNT)).join(totals, "code")
    root = signed_root_column(F.least("toxic", "toxic_docs"), F.col("toxic_docs"), F.least(F.col("toxic") + F.col("clean"), F.col("toxic_docs") + F.col("clean_docs")), F.col("toxic_docs") + F.col("clean_docs"))
    nodes = nodes.withColumn("kind", F.when(root >= MIN_ROOT, 1).when((root <= 0) & (F.col("clean") > 0), -1).otherwise(0))
    nodes = cut(nodes.select("term", "code", "n", "uses", "total", "toxic", "clean", "kind"), "nodes")
    drop(counted)
    drop(languages)
    graph = cut(wordgraph.edges(wordgraph.pairs(_keyed(docs).select("code", "text"), terms, sketches, nodes, stop, wordgraph.WINDOW * seen, ranked=ranked)), "graph")
    number = nodes.where("kind != 0").groupBy("code").agg(*[F.sum((F.col("kind") == k).cast("long")).alias(c) for k, c in ((1, "bad"), (-1, "good"))]).where("bad > 0")
    chance = lambda k, c: F.when(F.col("kind") == k, 1 / F.col(c)).otherwise(0.0)
    origin = nodes.where("kind != 0").join(number, "code").select("term", chance(1, "bad").alias("t"), chance(-1, "good").alias("c"))
    visits = wordgraph.walk(graph, origin, ["t", "c"])
    polarity = (F.col("t") - F.col("c")) / (F.col("t") + F.col("c"))
    share = (F.col("toxic") + PRIOR * F.greatest(F.lit(0.0), F.col("polarity"))) / (F.col("toxic") + F.col("clean") + PRIOR)
    visited = visits.where("t + c > 0").select("term", polarity.alias("polarity"))
    return nodes.join(visited, "term").select("term", "code", "n", "toxic", "clean", (F.col("kind") == 1).alias("is_seed"), "polarity", share.alias("share"))


def induce(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, ranked: int = wordgraph.RANKED) -> Lexicon:
    """The terms of :func:`polarities` with at least MIN_POLARITY and MIN_SHARE, in order of their hashes."""
    rows = polarities(docs, labels, max_labelled, ranked).where((F.col("polarity") >= MIN_POLARITY) & (F.col("share") >= MIN_SHARE)).select("term", "code", "polarity", "share").toArrow().sort_by("term")
    return Lexicon(rows.column("term").to_numpy().view(U), *(rows.column(c).to_numpy() for c in ("code", "polarity", "share")))


SCORES = "doc_id long, score double, hits int, tokens int, rate double, toxic int"


def score(docs: DataFrame, lexicon: Lexicon, min_score: float = MIN_SCORE, min_rate: float = MIN_RATE) -> DataFrame:
    """One row a document: the summed weights of its lexicon terms, how many it has, and whether it is toxic.

    Documents without a language, or of one without lexicon terms, are scored by the terms of all languages. A map over
    whole texts of any length; the lexicon is broadcast, 16 bytes a term. Null, empty and wordless texts score 0 and
    aren't toxic; a score that ties with a limit is toxic; repeated rows give repeated rows; a null id stays null, and one
    that is no integer becomes null; an empty table gives an empty one; other columns aren't read.
    """
    known = docs.sparkSession.sparkContext.broadcast(_scorer(lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, chunk in terms(batch.column(2), _scored_as(batch.column(1), known.value)):
                columns = _scored(chunk, known.value, min_score, min_rate)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, chunk.hi - chunk.lo), *map(pa.array, columns)], names=[x.split()[0] for x in SCORES.split(", ")])

    return map_texts(_keyed(docs).select("doc_id", "code", "text"), run, SCORES)


def _scorer(lexicon: Lexicon) -> tuple[Filter, np.ndarray, np.ndarray]:
    """(hashes, their weights, languages with terms of their own); NO_LANGUAGE has the terms of all, at their highest weight."""
    own = lexicon.code != NO_LANGUAGE
    hashes = np.concatenate([lexicon.term[own], mix(lexicon.hashes ^ U(NO_LANGUAGE))])
    words = Filter(hashes)
    weight = np.zeros(len(words.values))
    np.maximum.at(weight, np.searchsorted(words.values, hashes), np.concatenate([lexicon.weight[own], lexicon.weight]))
    return words, weight, np.unique(lexicon.code[own])


def _scored_as(codes: pa.Array, scorer: tuple[Filter, np.ndarray, np.ndarray]) -> pa.Array:
    codes = codes.to_numpy()
    return pa.array(np.where(np.isin(codes, scorer[2]), codes, NO_LANGUAGE))


def _scored(chunk: Chunk, scorer: tuple[Filter, np.ndarray, np.ndarray], min_score: float, min_rate: float) -> tuple[np.ndarray, ...]:
    words, weight, _ = scorer
    at, which = words.find(chunk.hashes)
    doc = np.searchsorted(chunk.offsets, at, "right") - 1
    size, tokens = chunk.hi - chunk.lo, chunk.counts
    total, hits = np.bincount(doc, weight[which], size).astype(float), np.bincount(doc, minlength=size)
    rate = total / np.maximum(tokens, 1)
    toxic = (total >= min_score) & (rate >= min_rate)
    return total, hits.astype(np.int32), tokens.astype(np.int32), rate, toxic.astype(np.int32)


def toxic_documents(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of :func:`score` that are toxic, by the lexicon that :func:`induce` finds in ``docs``.

    Without labels, toxic ones or documents there are none.
    """
    return score(docs, induce(docs, labels, **parameters)).where("toxic = 1").drop("toxic")


def without_toxic(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE, min_rate: float = MIN_RATE, **parameters) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, columns as they are; a map over the rows, without a join.

    Null, empty and wordless texts stay, repeated rows stay or go together, columns of any names are passed on.
    """
    known = docs.sparkSession.sparkContext.broadcast(_scorer(induce(docs, labels, **parameters)))
    at, width = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [_scored(chunk, known.value, min_score, min_rate)[-1] == 0 for _, chunk in terms(batch.column(at), _scored_as(batch.column(width), known.value))]
            if clean:
                yield batch.select(range(width)).filter(pa.array(np.concatenate(clean)))

    return map_texts(docs.withColumn(*fresh(docs, "__code"), _code(docs)), run, docs.schema)
