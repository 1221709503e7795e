"""Line templates against a plain parser, and odd inputs."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.llm import linetemplates as L

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def mask(line):
    return " ".join(L.WILD if re.search(r"\d", w) else w for w in re.split(r"[ \t\r\f\v]+", line) if w)


def plain_cluster(lines, similarity=L.SIMILARITY):
    """Compares every line with every template."""
    templates, out = [], []
    for line in lines:
        t = line.split(" ")
        allowed = int(len(t) * (1 - similarity) + 1e-9)
        scores = [sum(a == b for a, b in zip(x, t)) for x in templates]
        best = max(range(len(scores)), key=lambda i: (scores[i], -i), default=None)
        if best is not None and scores[best] >= len(t) - allowed:
            templates[best] = [a if a == b else L.WILD for a, b in zip(templates[best], t)]
            out.append(best)
        else:
            templates.append(t)
            out.append(len(templates) - 1)
    return out, templates


def brute(rows, min_docs):
    docs = {}
    for i, t in rows:
        if t is not None:
            docs[i, t] = [mask(x) for x in t.split("\n")]
    counts = {}
    for i, t in rows:
        for line in set(mask(x) for x in (t or "").split("\n")) - {""}:
            counts[line] = counts.get(line, 0) + 1
    leaves = {}
    for line in counts:
        w = line.split(" ")
        leaves.setdefault((len(w), *w[: L.LEADING]), []).append(line)
    template = {}
    for leaf, lines in leaves.items():
        lines.sort(key=lambda x: (-counts[x], x))
        which, found = plain_cluster(lines)
        for line, k in zip(lines, which):
            if sum(x != L.WILD for x in found[k]) >= L.CONSTANT * len(found[k]):
                template[line] = (leaf, " ".join(found[k]))
    held = {}
    for k, lines in docs.items():
        for line in lines:
            if line in template:
                held.setdefault(template[line], set()).add(k)
    return {(k[0], n, len(held[template[line]])) for k, lines in docs.items() for n, line in enumerate(lines) if line in template and len(held[template[line]]) >= min_docs}


def rows(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "x1", "2024"]
    logs = ["Page {} of {}", "user {} logged in from {} at noon today", "Copyright {} Some Company Inc all rights reserved", "see the terms  of\tservice"]
    out = []
    for i in range(150):
        lines = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(rng.randint(0, 5))]
        for _ in range(rng.choice([0, 1, 2])):
            lines.insert(rng.randint(0, len(lines)), rng.choice(logs).format(rng.randint(1, 99), rng.choice(["10.0.0.1", "home", "work"])))
        out.append((i, "\n".join(lines)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_are_those_of_the_plain_parser(spark, seed):
    data = rows(seed)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], SCHEMA)
    got = {(r.doc_id, r.line, r.n_docs) for r in L.recurring_lines(docs.repartition(5)).collect()}
    assert got == brute(data, L.MIN_DOCS) and len(got) > 50


def test_clustering_with_blocks_is_that_of_all_comparisons():
    rng = random.Random(7)
    for size in (1, 2, 4, 7, 12):
        lines = sorted({" ".join(rng.choices("abc", k=size)) for _ in range(150)})
        which, templates = L.cluster(lines)
        want, plain = plain_cluster(lines)
        assert which == want and templates == plain


def test_variable_fields_become_wild(spark):
    docs = spark.createDataFrame([(i, f"Order {i} was shipped to {name} by express courier on Monday") for i, name in enumerate(["Ann", "Bob", "Cy", "Di", "Ed", "Flo"])], "doc_id long, text string")
    (row,) = L.line_templates(docs).select("template").distinct().collect()
    assert row.template == "Order <*> was shipped to <*> by express courier on Monday"
    assert L.recurring_lines(docs).count() == 6 and L.recurring_lines(docs, 7).count() == 0


def test_a_template_of_one_document_doesn_t_recur(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"item {i} is {w} here now" for i, w in enumerate("abcdefgh")))], "doc_id long, text string")
    assert L.recurring_lines(docs).count() == 0


def test_lines_are_dropped(spark):
    foot = "all rights reserved by us"
    docs = spark.createDataFrame([(i, f"{chr(97 + i) * 9} own {chr(97 + i) * 4}\n{foot}\nlast {chr(97 + i) * 5}", "en", "s", 0) for i in range(6)], SCHEMA)
    left = L.without_recurring_lines(docs)
    assert left.schema == docs.schema and all(foot not in r.text and r.text.count("\n") == 1 for r in left.collect())


def test_odd_rows(spark):
    long = "w " * 200_000
    data = [(None, "same line here", None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "\n \n", "en", "s", 0), (4, long, "en", "s", 0), *[(10 + i, "same line here", "en", "s", 0) for i in range(4)], (10, "same line here", "en", "s", 0), (20, "12 34\n5 6", "en", "s", 0)]
    docs = spark.createDataFrame(data, SCHEMA).withColumn("line", F.lit(1)).withColumn("hash", F.lit(1)).withColumn("__key", F.lit(1)).withColumn("leaf", F.lit(1))
    got = sorted((r.doc_id or -1, r.line, r.n_docs) for r in L.recurring_lines(docs).collect())
    assert got == [(-1, 0, 5), (10, 0, 5), (11, 0, 5), (12, 0, 5), (13, 0, 5)]
    left = L.without_recurring_lines(docs)
    assert left.columns == docs.columns and left.count() == len(data) and left.where("doc_id = 1").first().text is None
    assert L.recurring_lines(docs.limit(0)).count() == 0 and L.without_recurring_lines(docs.limit(0)).count() == 0


def test_a_leaf_of_half_the_corpus_is_split_by_the_first_half_of_its_tokens(spark):
    rng = random.Random(3)
    names = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(400)]
    data = [(i, f"the user logged in from the house of {n}\nthe user {n[:2]}{n} left for a walk in rain") for i, n in enumerate(names)] + [(1000 + i, f"own line {n} of document") for i, n in enumerate(names)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    whole = {(r.line, r.template) for r in L.line_templates(docs).collect()}
    split = {(r.line, r.template) for r in L.line_templates(docs, most_lines=100).collect()}
    # variable tokens in the second half are found as before
    assert {x for x in whole if x[0].startswith("the user logged")} <= split
    # one in the first half leads to leaves of its own
    assert any("left for a walk" in t for _, t in whole) and not any("left for a walk" in t for _, t in split)
    sizes = docs.select(F.explode(F.split("text", "\n")).alias("l")).distinct().groupBy(L.leaf_of(F.col("l"))).count()
    assert sizes.where("count > 100").count() > 0


def test_a_leaf_of_over_100_000_lines_is_one_tree_leaf_like_any_other(spark):
    name = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    docs = spark.range(100_100).select(F.col("id").alias("doc_id"), F.concat(F.lit("the user "), name, F.lit(" left for a walk in rain")).alias("text"))
    (row,) = L.line_templates(docs).groupBy("template").count().collect()
    assert (row.template, row["count"]) == ("the user <*> left for a walk in rain", 100_100)
    assert L.recurring_lines(docs).groupBy("n_docs").count().collect() == [(100_100, 100_100)]


@pytest.mark.parametrize("leading", [0, 2])
def test_clustering_as_arrays_is_that_of_all_comparisons(leading):
    rng = random.Random(11)
    for size in (1, 2, 3, 4, 5, 7, 8, 11, 14):
        for words in ("abc", ["a", "b", "c", "d", L.WILD], [f"w{k}" for k in range(40)] + [L.WILD]):
            lines = list(dict.fromkeys(" ".join(["in", "the"][:leading] + rng.choices(words, k=max(0, size - leading))) for _ in range(300)))
            if size < leading:
                continue
            rng.shuffle(lines)
            which, plain = plain_cluster(lines)
            begun, tokens, vocabulary, wild = L.cluster_many(pa.array(lines, pa.large_string()), leading=leading)
            assert [int(begun[which.index(k)]) for k in which] == begun.tolist() and len(set(begun.tolist())) == len(plain)
            assert [[vocabulary[t].as_py() for t in tokens[i]] for i in sorted(set(begun.tolist()))] == plain and vocabulary[wild].as_py() == L.WILD
            listed, templates = L.cluster(lines, leading=leading)
            assert listed == which and templates == plain


def test_large_leaves_give_the_rows_of_small_ones(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows(5)], SCHEMA).repartition(3)
    want = sorted(map(tuple, L.line_templates(docs, 2).collect()))
    assert sorted(map(tuple, L.line_templates(docs, 2, listed=2).collect())) == want and len(want) > 20
