"""Structure of key sets, against the binary format and brute force."""

import os

from pyspark.sql import functions as F

from keyloom import schema
from keyloom.operators import analyze, build
from keyloom.sources import trie

KEYS = ["a", "ab", "abc", "abd", "b", "xyz", "xyzw"]


def table(spark, words):
    return spark.createDataFrame([(w,) for w in words], "key string")


def test_nodes_and_branches(spark):
    nodes = {bytes(r.prefix).decode(): (r.keys, r.terminal) for r in analyze.prefix_nodes(table(spark, [*KEYS, "a", ""])).collect()}
    assert len(nodes) == 9 and nodes["ab"] == (3, True) and nodes["xy"] == (2, False)
    fan = {bytes(r.prefix).decode(): (r.children, r.terminal) for r in analyze.branch_fanout(table(spark, KEYS)).collect()}
    assert fan[""] == (3, False) and fan["ab"] == (2, True) and fan["xyzw"] == (0, True)
    assert {bytes(r.prefix).decode(): r.terminal for r in analyze.branch_fanout(table(spark, ["", "a"])).collect()} == {"": True, "a": True}


def test_common_prefixes(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", "a"), ("x", "y"), ("é1", "é2"), ("aa", "aa")], "a string, b string")
    assert [r[0] for r in df.select(analyze.common_prefix(F.col("a"), F.col("b")).cast("string")).collect()] == ["ab", "", "", "é", "aa"]
    shared = {r.key: r.shared for r in analyze.shared_prefixes(table(spark, KEYS)).collect()}
    assert shared == {"a": 0, "ab": 1, "abc": 2, "abd": 2, "b": 0, "xyz": 0, "xyzw": 3}
    groups = {r.g: (r.keys, bytes(r.prefix).decode()) for r in analyze.group_prefixes(spark.createDataFrame([(1, "abc"), (1, "abd"), (2, "x")], "g int, key string"), "g").collect()}
    assert groups == {1: (2, "ab"), 2: (1, "x")}


def test_symbols_suffixes_and_subtrees(spark):
    stats = {r.byte: (r.n, r.code) for r in analyze.symbol_stats(table(spark, ["ab", "b", ""])).collect()}
    assert stats == {97: (1, 6), 98: (2, 7)}
    assert {r.suffix: r.keys for r in analyze.suffix_stats(table(spark, ["sing", "ring", "go", "ing"])).collect()} == {"ing": 3}
    merged = analyze.mergeable_subtrees(table(spark, ["tap", "top"])).first()
    assert (merged.nodes, merged.classes) == (6, 4)
    assert {bytes(r["next"]): r["keys"] for r in analyze.child_groups(table(spark, KEYS), 1).collect()} == {b"b": 3, b"y": 2}


def test_value_sizes_are_those_of_the_format(spark):
    values = [(2, "int", -100), (3, "uint", 200), (2, "int", -(1 << 63)), (3, "uint", (1 << 64) - 1)]
    for tag, kind, v in values:
        payload = schema.int64(F.lit(v)) if kind == "int" else schema.uint64(F.lit(str(v)).cast("decimal(20,0)"))
        entries = schema.entries(spark.range(1), F.lit("k"), payload)
        assert entries.select(analyze.value_bits()).first()[0] == len(trie._value_bits(tag, v, 0))


def test_words_and_values(spark):
    assert analyze.words(spark, ["do", "undo"], ["", "un"], ["", "ing"]).count() == 6
    entries = build.build(schema.entries(spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "k string, v int"), F.col("k"), schema.int64(F.col("v"))))
    row = analyze.value_stats(entries).first()
    assert (row["values"], row.distinct_values) == (2, 1)


def test_shared_starts_are_counted_in_bytes(spark):
    df = spark.createDataFrame([("aè", "aé"), ("è", "é"), ("日", "月"), (None, "a"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(analyze.shared_bytes(F.col("a"), F.col("b"))).collect()] == [2, 1, 1, None, 0]
    assert bytes(df.select(analyze.common_prefix(F.col("a"), F.col("b"))).first()[0]) == "aè".encode()[:2]
    words = sorted({f"{a}{b}{c}" for a in "cé" for b in "aèé日" for c in range(40)}, key=str.encode)
    want = {k: len(os.path.commonprefix([k.encode(), p.encode()])) for k, p in zip(words, ["", *words])}
    assert {r.key: r.shared for r in analyze.shared_prefixes(table(spark, [*words, *words[:9], None]).repartition(7)).collect()} == want
    assert analyze.shared_prefixes(table(spark, [])).count() == 0
