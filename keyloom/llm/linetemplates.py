"""Parse lines into templates by a tree of fixed depth, and drop the templates that recur across documents."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.minhash import key_of
from keyloom.llm.tokens import U, mix, partitions, total_bytes
from keyloom.plans.lineage import cut, sized
from keyloom.plans.names import fresh
from keyloom.plans.sizing import release

#: Tokens that lead to a leaf, after the number of tokens.
LEADING = 2
#: Least share of tokens that a line has in common with its template.
SIMILARITY = 0.7
#: Least share of a template's tokens that don't vary; else lines of numbers would be one template.
CONSTANT = 0.5
#: Documents in which a template recurs.
MIN_DOCS = 5
#: Lines of a leaf that are clustered as Python strings; more are clustered as arrays, with the same result.
LISTED = 1 << 12
WILD = "<*>"


def masked_lines(text: Column) -> Column:
    """The lines of a text; tokens with a digit are wild, and runs of blanks are one space."""
    lines = F.split(F.regexp_replace(text, r"[\t\r\f\x0B ](?<=[^ ])[\t\r\f\x0B ]*| [\t\r\f\x0B ]+", " "), "\n")
    wild = lambda line: F.when(line.rlike(r"\d"), F.regexp_replace(line, r"(?<!\S)[^\s\d]*+\d\S*", WILD)).otherwise(line)
    return F.transform(lines, lambda line: wild(F.trim(line)))


def leaf_of(line: Column, leading: int = LEADING) -> Column:
    """The leaf of a line: its number of tokens and the first of them."""
    return F.xxhash64(_blanks(line), F.substring_index(line, " ", leading))


def _blanks(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))


def deeper_leaf_of(line: Column) -> Column:
    """The leaf of a line where a caller has large leaves branch on: the first half of its tokens leads there."""
    half = F.floor((_blanks(line) + 2) / 2).cast("int")
    return F.xxhash64(_blanks(line), F.lit("half"), F.call_function("substring_index", line, F.lit(" "), half))


def _bounds(size: int, similarity: float, leading: int) -> list[int]:
    """The bounds of one block of tokens more than a line may have differing ones; all lines share the ``leading`` tokens."""
    allowed = int(size * (1 - similarity) + 1e-9)
    leading = min(leading, size)
    return [leading + (size - leading) * k // (allowed + 1) for k in range(allowed + 2)]


def cluster(lines: list[str], similarity: float = SIMILARITY, leading: int = 0) -> tuple[list[int], list[list[str]]]:
    """(template of each line, templates) for the lines of one leaf, in order.

    A line joins the template with which it shares the most tokens, if they are at least ``similarity`` of them, and
    the first of several; tokens that differ become wild. Else it is a new template. With m differing tokens allowed,
    one of m + 1 blocks of tokens must agree, so only templates that share a block are compared. Blocks leave out the
    ``leading`` tokens, which all lines share.
    """
    templates: list[list[str]] = []
    index: dict[tuple, list[int]] = {}
    out = []
    size = lines[0].count(" ") + 1 if lines else 0
    bounds = _bounds(size, similarity, leading)
    allowed = len(bounds) - 2
    for line in lines:
        tokens = line.split(" ")
        blocks = [(k, *tokens[bounds[k] : bounds[k + 1]]) for k in range(allowed + 1)]
        best, score = -1, size - allowed - 1
        for i in sorted({i for b in blocks for i in index.get(b, ())}):
            same = sum(map(str.__eq__, templates[i], tokens))
            if same > score:
                best, score = i, same
        if best < 0:
            best = len(templates)
            templates.append(tokens)
            fresh = blocks
        else:
            old = templates[best]
            new = [x if x == y else WILD for x, y in zip(old, tokens)]
            fresh = [(k, *new[bounds[k] : bounds[k + 1]]) for k in range(allowed + 1) if new[bounds[k] : bounds[k + 1]] != old[bounds[k] : bounds[k + 1]]]
            templates[best] = new
        for b in fresh:
            index.setdefault(b, []).append(best)
        out.append(best)
    return out, templates


def _block_hashes(tokens: np.ndarray, bounds: list[int]) -> np.ndarray:
    out = np.empty((len(tokens), len(bounds) - 1), U)
    for k in range(len(bounds) - 1):
        h = mix(np.full(len(tokens), k + 1, U))
        for c in range(bounds[k], bounds[k + 1]):
            h = mix(h ^ tokens[:, c].astype(U))
        out[:, k] = h
    return out


def cluster_many(lines: pa.Array, similarity: float = SIMILARITY, leading: int = 0) -> tuple[np.ndarray, np.ndarray, pa.Array, int]:
    """:func:`cluster` of a large leaf: (first line of each line's template, tokens, vocabulary, number of WILD in it).

    Row i of the tokens has the template that line i began. Tokens are numbers, and a line takes some 4 bytes a token and
    8 a block besides its text.

    A line without wild tokens joins a template only by a block that the template's first line has, and the first line to
    join a template shares a block with the one that began it. So a line that has no wild token and shares no block
    with another line is a template of its own, and is neither compared nor indexed.
    """
    words = pc.split_pattern(lines, " ").flatten().dictionary_encode()
    vocabulary, tokens = words.dictionary, words.indices.to_numpy(zero_copy_only=False).reshape(len(lines), -1).copy()
    wild = pc.index(vocabulary, pa.scalar(WILD, vocabulary.type)).as_py()
    if wild < 0:
        wild = len(vocabulary)
        vocabulary = pa.concat_arrays([vocabulary, pa.array([WILD], vocabulary.type)])
    size = tokens.shape[1]
    bounds = _bounds(size, similarity, leading)
    first, least = bounds[0], size - (len(bounds) - 2) - bounds[0]
    hashes = _block_hashes(tokens, bounds)
    shared = np.empty(hashes.shape, bool)
    for k in range(len(bounds) - 1):
        _, which, times = np.unique(hashes[:, k], return_inverse=True, return_counts=True)
        shared[:, k] = times[which] > 1
    begun = np.arange(len(lines))
    index: dict[int, array] = {}
    for i in np.flatnonzero(shared.any(axis=1) | (tokens[:, first:] == wild).any(axis=1)).tolist():
        mine = hashes[i].tolist()
        near = [np.frombuffer(index[h], np.int64) for h in mine if h in index]
        best = -1
        if near:
            near = np.concatenate(near)
            same = (tokens[near, first:] == tokens[i, first:]).sum(axis=1)
            most = same.max()
            if most >= least:
                best = int(near[same == most].min())
        if best < 0:
            for h, known in zip(mine, shared[i].tolist()):
                if known:
                    index.setdefault(h, array("q")).append(i)
            continue
        begun[i] = best
        differs = (tokens[best] != tokens[i]) & (tokens[best] != wild)
        if differs.any():
            tokens[best, differs] = wild
            (now,) = _block_hashes(tokens[best : best + 1], bounds)
            for h in now[now != hashes[best]].tolist():
                index.setdefault(h, array("q")).append(best)
            hashes[best] = now
    return begun, tokens, vocabulary, wild


def line_templates(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, constant: float = CONSTANT, leading: int = LEADING, most_lines: int | None = None, listed: int = LISTED) -> DataFrame:
    """(line, template): the masked lines whose template may recur in ``min_docs`` documents.

    Lines are counted by Spark, so a line that the whole corpus has is one row; a leaf's lines then meet in one task, the
    most frequent first, ties by their text. Leaves and templates with fewer lines than ``min_docs`` are left out.

    A leaf is whole however many lines it has: which template a line joins depends on all lines before it, so that one leaf
    is one task's work. Of more than ``listed`` lines, :func:`cluster_many` holds numbers in place of strings.

    Only a caller that gives ``most_lines`` has leaves of more distinct lines branch on to leaves by the first half of
    their tokens; templates there vary in the second half only, so that they depend on the size of the leaf.
    """
    line = docs.select(F.explode(F.array_distinct(masked_lines(F.col("text").cast("string")))).alias("line")).where("line != ''")
    counted = line.groupBy("line").agg(F.count(F.lit(1)).alias("n")).withColumn("leaf", leaf_of(F.col("line"), leading))
    if most_lines is not None:
        # the sum is there to read the same counts as the rest of the plan, so that lines are shuffled once for both
        large = counted.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("all")).where((F.col("lines") > most_lines) & (F.col("all") >= F.col("lines"))).select("leaf", F.lit(True).alias("large"))
        counted = counted.join(F.broadcast(large), "leaf", "left").withColumn("leaf", F.when(F.col("large"), deeper_leaf_of(F.col("line"))).otherwise(F.col("leaf")))
    led = leading if most_lines is None else 0

    def found(lines: list[str], counts: list[int]) -> tuple[list[str], list[str]]:
        if sum(counts) < min_docs:
            return [], []
        order = sorted(range(len(lines)), key=lambda i: (-counts[i], lines[i]))
        which, templates = cluster([lines[i] for i in order], similarity, led)
        total = [0] * len(templates)
        for i, t in zip(order, which):
            total[t] += counts[i]
        good = [n >= min_docs and sum(x != WILD for x in t) >= constant * len(t) for n, t in zip(total, templates)]
        text = [" ".join(t) for t in templates]
        kept = [(lines[i], text[t]) for i, t in zip(order, which) if good[t]]
        return [x for x, _ in kept], [x for _, x in kept]

    def found_in_many(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf = pa.Table.from_batches(parts).sort_by([("n", "descending"), ("line", "ascending")])
        parts.clear()
        lines, counts = leaf.column("line").combine_chunks(), leaf.column("n").to_numpy()
        begun, tokens, vocabulary, wild = cluster_many(lines, similarity, led)
        total = np.bincount(begun, counts, len(lines))
        good = np.flatnonzero(total >= min_docs)
        good = good[(tokens[good] != wild).sum(axis=1) >= constant * tokens.shape[1]]
        kept = np.flatnonzero(np.isin(begun, good))
        for lo in range(0, len(kept), LISTED):
            own = kept[lo : lo + LISTED]
            which, at = np.unique(begun[own], return_inverse=True)
            text = pa.array([" ".join(vocabulary.take(pa.array(t)).to_pylist()) for t in tokens[which]], pa.string())
            yield pa.RecordBatch.from_arrays([lines.take(pa.array(own)).cast(pa.string()), text.take(pa.array(at))], names=["line", "template"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, lines, counts = None, [], []
        parts: list[pa.RecordBatch] = []

        def put_by() -> None:
            parts.append(pa.RecordBatch.from_arrays([pa.array(lines, pa.large_string()), pa.array(counts, pa.int64())], names=["line", "n"]))
            lines.clear()
            counts.clear()

        for batch in batches:
            out: tuple[list[str], list[str]] = ([], [])
            for now, line, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if now != leaf:
                    if parts:
                        put_by()
                        yield from found_in_many(parts)
                        release()
                    else:
                        for a, b in zip(out, found(lines, counts)):
                            a += b
                    leaf, lines, counts = now, [], []
                if len(lines) == listed:
                    put_by()
                lines.append(line)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], names=["line", "template"])
        if parts:
            put_by()
            yield from found_in_many(parts)
            release()
        else:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in found(lines, counts)], names=["line", "template"])

    spread = partitions(docs.sparkSession, total_bytes(docs, "text"))
    return counted.select("leaf", "line", "n").repartition(spread, "leaf").sortWithinPartitions("leaf").mapInArrow(run, "line string, template string")


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, **parameters) -> DataFrame:
    """(doc_id, key, line, template_id, n_docs): every line, by its number from 0, whose template is in ``min_docs`` documents.

    The tree sends a line to a leaf by its number of tokens and its first tokens, where it joins the most similar
    template (see :func:`cluster`). All lines of a recurring template are to be dropped, the first one too. Documents
    of a template are counted exactly, by the distinct ``key`` of id and text.

    Two scans of the texts; lines are shuffled once to be counted and once as hashes to be found again (or not at all,
    where few lines recur and are broadcast). A line of very many documents is one row of the count, and AQE
    splits the join that finds it.

    Null and empty texts and blank lines have no template. Rows of equal id and text are one document. A null id
    stays null, one that is no integer becomes null. Lines of any length are parsed whole. An empty table gives an empty one; other columns aren't read.
    """
    known = cut(line_templates(docs, min_docs, **parameters).select(F.xxhash64("line").alias("hash"), F.xxhash64("template").alias("template_id")), "templates")
    keyed = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), key_of().alias("key"), masked_lines(F.col("text").cast("string")).alias("lines"))
    lines = keyed.select("doc_id", "key", F.posexplode("lines").alias("line", "masked")).where("masked != ''").select("doc_id", "key", "line", F.xxhash64("masked").alias("hash"))
    found = cut(lines.join(sized(known), "hash").drop("hash"), "lines")
    often = cut(found.groupBy("template_id").agg(F.count_distinct("key").alias("n_docs")).where(F.col("n_docs") >= min_docs), "recurring")
    return found.join(sized(often), "template_id").select("doc_id", "key", "line", "template_id", "n_docs").distinct()


def without_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, **parameters) -> DataFrame:
    """``docs`` without the lines of :func:`recurring_lines`; the columns stay as they are.

    Null texts stay null; a text of which no line is left is ''. Very long texts and repeated rows are handled like
    others, an empty table gives an empty one, and columns of any names are passed on.
    """
    key, lines = fresh(docs, "__key", "__lines")
    gone = recurring_lines(docs, min_docs, **parameters).groupBy(F.col("key").alias(key)).agg(F.collect_set("line").alias(lines))
    joined = docs.withColumn(key, key_of()).join(gone, key, "left")
    left = F.array_join(F.filter(F.split(F.col("text").cast("string"), "\n"), lambda _, i: ~F.array_contains(lines, i)), "\n")
    text = F.when(F.col(lines).isNull(), F.col("text")).otherwise(left)
    return joined.select(*[text.alias(c) if c == "text" else joined[c] for c in docs.columns])
