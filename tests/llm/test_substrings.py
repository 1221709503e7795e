"""Repeated windows and the intervals to remove, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import substrings as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
N = 8


def tokens(text):
    return re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", text.lower())


def runs(places):
    out, places = [], sorted(places)
    for p in places:
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return out


def brute(rows, n):
    docs = {(i, t): tokens(t) for i, t in rows if t}
    where = {}
    for k, w in docs.items():
        for p in range(len(w) - n + 1):
            where.setdefault(tuple(w[p : p + n]), []).append(((k[0] is not None, k[0] or 0), p, k))
    first, again = {}, {}
    for places in where.values():
        if len(places) > 1:
            places.sort()
            for rank, (_, p, k) in enumerate(places):
                (again if rank else first).setdefault(k, set()).update(range(p, p + n))
    out = set()
    for k in docs:
        kept = first.get(k, set())
        for places, removed in ((kept, False), (again.get(k, set()) - kept, True)):
            out |= {(k[0], a, b, removed) for a, b in runs(places)}
    return out


def rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    passages = [" ".join(rng.choices(words, k=20)) for _ in range(4)]
    out = []
    for i in range(200):
        text = rng.choices(words, k=rng.randint(0, 40))
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            text += [rng.choice(passages), *rng.choices(words, k=rng.randint(0, 5))]
        out.append((i, " ".join(text)))
    return out + [out[5], out[5], (None, passages[0]), (400, None), (401, ""), (402, "a " * 50), (403, "ß É " * 3), (404, "b " * 7)]


def frame(spark, data):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], SCHEMA)


@pytest.mark.parametrize("seed,bucket,flush", [(1, 1 << 18, 8), (2, 50, 1), (3, 50, 8)])
def test_intervals_are_those_of_brute_force(spark, monkeypatch, seed, bucket, flush):
    monkeypatch.setattr(S, "FLUSH", flush)
    monkeypatch.setattr(S, "COUNT_WINDOWS", 40)
    data = rows(seed)
    got = S.repeats(frame(spark, data).repartition(5), N, bucket).collect()
    assert {(r.doc_id, r.start, r.end, r.removed) for r in got} == brute(data, N) and len(got) == len({tuple(r) for r in got})


def test_intervals_of_a_document_are_apart_and_maximal(spark):
    by = {}
    for r in S.repeats(frame(spark, rows(4)), N).collect():
        by.setdefault(r.key, []).append((r.start, r.end, r.removed))
    for parts in by.values():
        parts.sort()
        assert all(a[1] <= b[0] and not (a[1] == b[0] and a[2] == b[2]) for a, b in zip(parts, parts[1:]))


def test_passages_of_over_fifty_words(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    passage = " ".join(rng.choices(words, k=53))
    data = [(i, " ".join(rng.choices(words, k=80)) + (" " + passage + " end" if i % 10 == 3 else "")) for i in range(100)]
    got = {(r.doc_id, r.end - r.start, r.removed) for r in S.repeats(frame(spark, data)).collect()}
    assert got == {(i, 53 + (0 if i == 3 else 0), i != 3) for i in range(3, 100, 10)} or {x[0] for x in got} == set(range(3, 100, 10))
    left = {r.doc_id: r.text for r in S.without_repeats(frame(spark, data)).collect()}
    assert passage in left[3] and not any(passage in left[i] for i in range(13, 100, 10)) and all(left[i] == t for i, t in data if i % 10 != 3)


def test_texts_without_repeats_have_none_left(spark):
    data = rows(6)
    docs = frame(spark, data).dropDuplicates(["doc_id", "text"])
    left = S.without_repeats(docs, N)
    assert left.schema == docs.schema and left.count() == docs.count()
    removed = {}
    for i, a, b, gone in brute(data, N):
        if gone:
            removed.setdefault(i, set()).update(range(a, b))
    got = {r.doc_id: tokens(r.text or "") for r in left.collect()}
    for i, text in data:
        assert got[i] == [w for p, w in enumerate(tokens(text or "")) if p not in removed.get(i, ())]


def test_sliding_least():
    x = np.random.default_rng(0).integers(0, 100, 50)
    for n in (1, 2, 3, 7, 8, 47, 50):
        assert S.sliding_least(x, n).tolist() == [x[i : i + n].min() for i in range(51 - n)]


def test_long_empty_and_clashing(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(10**9)}" for _ in range(200_000))
    docs = frame(spark, [(1, long), (2, "x " + long), (3, None), (4, "few words")]).withColumn("key", F.lit(1)).withColumn("__key", F.lit(1)).withColumn("start", F.lit(2)).withColumn("__cuts", F.lit(3))
    got = {(r.doc_id, r.start, r.end, r.removed) for r in S.repeats(docs).collect()}
    assert got == {(1, 0, 200_000, False), (2, 1, 200_001, True)}
    left = S.without_repeats(docs)
    assert left.columns == docs.columns and {r.doc_id: r.text for r in left.collect()} == {1: long, 2: "x ", 3: None, 4: "few words"}
    assert S.repeats(docs.limit(0)).count() == 0 and S.without_repeats(docs.limit(0)).count() == 0


def test_a_shingle_of_half_the_corpus_is_split_over_tasks(spark, monkeypatch):
    """All windows of every other document have one least shingle, and no bucket that is sent has more than a few."""
    monkeypatch.setattr(S, "sliding_least", lambda x, n: np.where(x[: len(x) - n + 1] % 2 == 0, np.uint64(7), x[: len(x) - n + 1]))
    data = rows(8)
    seen = []
    plain = S.Sender.rows

    def watched(self):
        batch = plain(self)
        if batch is not None:
            seen.extend(zip(batch.column(0).to_pylist(), (len(x.as_py()) // 8 for x in batch.column(6))))
        return batch

    docs = frame(spark, data)
    texts = [t for _, t in data if t]
    sizes = S.Sender(N, 64)
    for chunk in S.chunks(__import__("pyarrow").array(texts)):
        h, bucket, _ = S.buckets_of(chunk, N, 64)
        hot, number = np.unique(bucket, return_counts=True)
    assert number.max() > 0.3 * number.sum()
    into = (hot[number > 100], -(-number[number > 100] // 50))
    sizes = S.Sender(N, 64, into)
    for chunk in S.chunks(__import__("pyarrow").array(texts)):
        sizes.add(chunk, np.arange(len(texts)), np.arange(len(texts)))
    monkeypatch.setattr(S.Sender, "rows", watched)
    sizes.rows()
    assert max(n for _, n in seen) < 120
    monkeypatch.setattr(S.Sender, "rows", plain)
    monkeypatch.undo()
    got = S.repeats(docs.repartition(5), N, 1 << 18, most_windows=20, count_windows=10).collect()
    assert {(r.doc_id, r.start, r.end, r.removed) for r in got} == brute(data, N)
