"""Near-duplicates: signatures by definition, recall against brute force, and odd inputs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.llm import minhash as M
from keyloom.llm.tokens import U, chunks, mix, windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n=120, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(30, 200))
        rows.append((i, " ".join(text), "en", "s", 0))
        for k in range(rng.choice([0, 0, 0, 1, 3])):
            copy = text[:]
            for _ in range(len(copy) // 25):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((1000 + 10 * i + k, " ".join(copy), "en", "s", 0))
    rng.shuffle(rows)
    return rows


def shingles(text):
    w = re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def test_groups_hold_every_near_copy_and_no_other_document(spark):
    rows = documents()
    found = {r.doc_id: r.keep_id for r in M.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    sets = {r[0]: shingles(r[1]) for r in rows}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= 0.65:
                assert found[a] == found[b]
            elif j < 0.1 and (a // 10 - 100 if a >= 1000 else a) != (b // 10 - 100 if b >= 1000 else b):
                assert a not in found or found[a] != found.get(b)


def test_signatures_don_t_depend_on_neighbours():
    texts = [r[1] for r in documents(40)]
    (alone,) = (M.signatures_of(c) for c in chunks(pa.array(texts[:1])))
    many = next(M.signatures_of(c) for c in chunks(pa.array(texts * 30)))
    assert (alone[1][0] == many[1][0]).all() and (many[1][0] == many[1][len(texts)]).all()


def test_signature_by_definition():
    text = "a b c d e f g"
    (chunk,) = chunks(pa.array([text]))
    h, _ = windows(chunk, 3)
    h = h & U(0xFFFFFFFFFF000000)
    sig, filled = np.zeros(M.BINS, np.uint16), np.zeros(M.BINS, bool)
    for x in sorted(h.tolist(), reverse=True):
        b = ((x >> 32) * M.BINS) >> 32
        sig[b], filled[b] = mix(np.array([x], U)).astype(np.uint16)[0], True
    full = sig.copy()
    for j in np.flatnonzero(~filled):
        full[j] = next(sig[d] for d in M.PREFERENCE[:, j] if filled[d])
    assert (M.signatures_of(chunk)[1][0] == full).all()


def test_shared_bins_estimate_the_similarity():
    rng = random.Random(3)
    a = [f"w{i}" for i in rng.choices(range(10**6), k=600)]
    b = a[:300] + [f"v{i}" for i in rng.choices(range(10**6), k=300)]
    (chunk,) = chunks(pa.array([" ".join(a), " ".join(b)]))
    sig = M.signatures_of(chunk)[1]
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.12


def test_buckets_make_stars(spark):
    sigs = spark.createDataFrame([(i, i, [7] * (M.BINS // M.ROWS)) for i in range(50)], "doc_id long, key long, bands array<long>")
    assert {(r.a, r.b) for r in M.star_edges(sigs).collect()} == {(0, i) for i in range(1, 50)}


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 3), (3, 9), (20, 21), (9, 5), (9, 9)]])
def test_components_against_union_find(spark, edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {(x, find(x)) for x in root if find(x) != x}
    assert {(r.node, r.root) for r in M.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_one_of_each_group_stays(spark):
    rows = documents(60)
    docs = spark.createDataFrame(rows, SCHEMA)
    groups = M.near_duplicates(docs).collect()
    gone = {r.doc_id for r in groups if r.key != r.keep_key}
    left = M.one_of_each_group(docs)
    assert sorted(r.doc_id for r in left.collect()) == sorted({r[0] for r in rows} - gone) and left.schema == docs.schema
    assert all(r.keep_id == min(x.doc_id for x in groups if x.keep_id == r.keep_id) for r in groups)


def test_nulls_empty_long_repeated_and_clashing(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(1, "same text here now", "en", "s", 0), (2, "same text here now", "en", "s", 0), (2, "same text here now", "en", "s", 0), (None, "same text here now", None, None, None), (3, None, "en", "s", 0), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (4, "", "en", "s", 0), (5, "...", "en", "s", 0), (6, "word", "en", "s", 0), (7, "word", "en", "s", 0), (2, "other words of one id", "en", "s", 0), (8, long, "en", "s", 0), (9, long + " x", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("__key", F.lit("x")).withColumn("bands", F.lit(2))
    got = {(r.doc_id, r.keep_id, r.group_size) for r in M.near_duplicates(docs).collect()}
    assert got == {(None, None, 3), (1, None, 3), (2, None, 3), (6, 6, 2), (7, 6, 2), (8, 8, 2), (9, 8, 2)}
    left = M.one_of_each_group(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, 2), (False, 3), (False, 3), (False, 4), (False, 4), (False, 5), (False, 6), (False, 8), (True, 0)]
    none = docs.limit(0)
    assert M.near_duplicates(none).count() == 0 and M.one_of_each_group(none).count() == 0
