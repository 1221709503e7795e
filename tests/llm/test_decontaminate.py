"""Benchmark items in documents, against brute force over every window."""

import random
import re
from math import ceil

import pytest
from pyspark.sql import functions as F

from keyloom.llm import decontaminate as D

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tokens(text):
    return re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", (text or "").lower())


def brute(docs, items, containment=D.CONTAINMENT, n=D.SHINGLE_TOKENS):
    out = {}
    for item, text in items:
        w = tokens(text)
        m = min(n, len(w))  # an item of fewer tokens is one shingle
        want = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set()
        need, size = max(1, ceil(len(want) * containment - 1e-9)), max(1, len(w) - m + 1)
        for doc, body in docs:
            v = tokens(body)
            have = [tuple(v[i : i + m]) for i in range(len(v) - m + 1)]
            best = max((len(want & set(have[i : i + size])) for i in range(len(have))), default=0)
            if want and best >= need:
                out[doc, item] = (best, need, len(want))
    return out


def cases(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(40)]
    docs = []
    for i in range(150):
        body = rng.choices(words, k=rng.randint(0, 80))
        for _ in range(rng.choice([0, 1, 1, 2])):
            part = tokens(rng.choice(items)[1])
            part = part[rng.randint(0, len(part) // 3) :]
            for _ in range(rng.choice([0, 1, 2])):
                part.insert(rng.randint(0, len(part)), rng.choice(words))
            at = rng.randint(0, len(body))
            body[at:at] = part
        docs.append((i, " ".join(body)))
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("per_pass", [D.ITEMS_PER_PASS, 7])
def test_matches_are_those_of_brute_force(spark, per_pass):
    docs, items = cases()
    got = {(r.doc_id, r.item_id): (r.matched, r.needed, r.total) for r in D.contaminated(*frames(spark, docs, items), items_per_pass=per_pass).collect()}
    assert got == brute(docs, items) and len(got) > 50


def test_contaminated_documents_go(spark):
    docs, items = cases(5)
    table, bench = frames(spark, docs, items)
    left = D.without_contaminated(table, bench)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {d for d, _ in brute(docs, items)} and left.schema == table.schema


def test_prefixes_can_t_be_done_without():
    items = D.Items.read(__import__("pyarrow").table({"item_id": [1], "text": ["a b c d e f g h i j k l"]}))
    assert items.needed(0.6).tolist() == [6] and items.prefixes(0.6).sum() == 5


def test_nulls_empty_long_repeated_and_clashing(spark):
    item = "one two three four five six seven"
    long = "x " * 300_000 + item + " y" * 10
    docs = [(1, item), (1, item), (None, item), (2, None), (3, ""), (4, "one two"), (5, long), (6, "nothing at all"), (1, "another text")]
    items = [(10, item), (11, item), (None, item), (12, None), (13, ""), (14, "zz yy"), (14, "ok")]
    table, bench = frames(spark, docs, items)
    table = table.withColumn("key", F.lit(0)).withColumn("__key", F.lit(0)).withColumn("item_id", F.lit("i"))
    got = sorted((r.doc_id or -1, r.item_id or -1) for r in D.contaminated(table, bench.withColumn("doc_id", F.lit(1))).collect())
    assert got == sorted((d, i) for d in (1, 1, -1, 5) for i in (10, 11, -1))
    left = D.without_contaminated(table, bench)
    assert left.columns == table.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4, 6]
    for a, b in ((table.limit(0), bench), (table, bench.limit(0)), (table.limit(0), bench.limit(0))):
        assert D.contaminated(a, b).count() == 0 and D.without_contaminated(a, b).count() == a.count()


def test_short_items_are_found_in_longer_documents(spark):
    items = [(1, "hello world"), (2, "Friend"), (3, "hello world"), (4, "world hello"), (5, "a b")]
    docs = [(1, "well hello world indeed my friend"), (2, "hello, world"), (3, "friend"), (4, "hello big world"), (5, "x " * 200_000 + "hello world")]
    got = {(r.doc_id, r.item_id): (r.matched, r.needed, r.total, r.token) for r in D.contaminated(*frames(spark, docs, items)).collect()}
    assert got == {(1, 1): (1, 1, 1, 1), (1, 3): (1, 1, 1, 1), (1, 2): (1, 1, 1, 5), (2, 1): (1, 1, 1, 0), (2, 3): (1, 1, 1, 0), (3, 2): (1, 1, 1, 0), (5, 1): (1, 1, 1, 200_000), (5, 3): (1, 1, 1, 200_000)}
    assert {k: v[:3] for k, v in got.items()} == brute(docs, items)


def test_passes_are_bounded_by_bytes(spark):
    docs, items = cases(6)
    got = {(r.doc_id, r.item_id): (r.matched, r.needed, r.total) for r in D.contaminated(*frames(spark, docs, items), bytes_per_pass=500).collect()}
    assert got == brute(docs, items)


def test_ids_that_are_no_integers(spark):
    docs = spark.createDataFrame([("x1", "one two three four"), ("x2", "nothing here to see"), ("7", "one two three four")], "doc_id string, text string")
    bench = spark.createDataFrame([("i", "one two three four")], "item_id string, text string")
    assert sorted(str(r.doc_id) for r in D.contaminated(docs, bench).collect()) == ["7", "None"]
    assert [r.doc_id for r in D.without_contaminated(docs, bench).collect()] == ["x2"]
