"""Construction, lookup, change and storage of dictionaries."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom import schema
from keyloom.dictionary import Dictionary, Encoder, Json
from keyloom.operators import build, lookup, search

NESTED = {"a": 1, "ab": 2, "abc": 3, "abd": 4, "b": 5, "xyz": 6, "xyzw": 7}


def table(spark, items):
    encoder = Encoder(spark)
    for key, value in items:
        encoder.insert(key, value)
    return encoder.entries()


def probe(spark, entries, *keys):
    rows = lookup.lookup(entries, spark.createDataFrame([(k,) for k in keys], "key string")).collect()
    return {r.key: (r.found, r.v_int) for r in rows}


def test_prefixes_and_extensions_of_keys_are_no_keys(spark):
    got = probe(spark, table(spark, NESTED.items()), *NESTED, "abcd", "xyzwv", "x", "", "ABC")
    assert {k: v for k, (found, v) in got.items() if found} == NESTED
    assert not any(got[k][0] for k in ("abcd", "xyzwv", "x", "", "ABC"))


def test_present_null_differs_from_missing(spark):
    d = Dictionary(table(spark, [("apple", 42), ("elderberry", None), ("", None)]))
    assert d.lookup("elderberry").tag == 0
    assert d.lookup("fig") is None
    assert "" in d and "fig" not in d and len(d) == 3


def test_the_last_of_equal_keys_counts_in_any_order_of_rows(spark):
    encoder = Encoder(spark)
    for v in (1, 2, 3):
        encoder.insert("key", v)
    assert len(encoder) == 3
    rows = encoder.rows[:]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        built = build.build(spark.createDataFrame(rows, schema.ENTRY).repartition(3)).collect()
        assert [(r.key, r.v_int) for r in built] == [("key", 3)]


def test_an_empty_dictionary(spark):
    empty = build.build(schema.empty(spark))
    assert empty.count() == 0
    assert probe(spark, empty, "a") == {"a": (False, None)}
    assert lookup.info(empty).count() == 0
    assert search.prefix(empty, "").count() == 0


def test_values_of_every_kind_keep_their_limits(spark):
    encoder = Encoder(spark)
    values = {"a": (1 << 63) - 1, "b": -(1 << 63), "c": (1 << 64) - 1, "d": 1e308, "e": "", "f": b"", "g": b"\0\xff", "h": False, "i": "é東"}
    for k, v in values.items():
        encoder.insert(k, v)
    rows = {r.key: r for r in encoder.entries().collect()}
    for k, v in values.items():
        got = [rows[k][c] for c in schema.COLUMNS if rows[k][c] is not None]
        assert len(got) == 1 and (bytes(got[0]) if isinstance(v, bytes) else int(got[0]) if isinstance(v, int) and not isinstance(v, bool) else got[0]) == v


def test_unsigned_values_out_of_range_are_refused(spark):
    df = spark.range(1).select(schema.uint64(F.lit("18446744073709551615").cast("decimal(20,0)")).alias("v"))
    assert int(df.first().v.v_uint) == (1 << 64) - 1
    with pytest.raises(Exception, match="unsigned"):
        spark.range(1).select(schema.uint64(F.col("id") - 1).alias("v")).collect()


def test_keys_are_in_the_order_of_their_bytes(spark):
    keys = ["b", "ab", "a", "é", "東", "\U0001f600", "", "Z"]
    got = [r.key for r in search.scan(table(spark, [(k, None) for k in keys])).collect()]
    assert got == sorted(keys, key=str.encode)


def test_binary_keys_may_hold_any_byte(spark):
    raw = schema.entries(spark.createDataFrame([(bytearray(b"a\0b"), 1), (bytearray(b"a"), 2)], "k binary, v int"), F.col("k"), schema.int64(F.col("v")))
    assert lookup.get(build.build(raw), bytearray(b"a\0b")).first().v_int == 1


def test_info_counts_distinct_bytes(spark):
    info = Dictionary(table(spark, [(k, None) for k in ("apple", "banana", "cherry")])).info()
    assert (info.num_keys, info.key_bytes, info.has_values, info.symbols, info.bits_per_symbol) == (3, 17, False, 10, 4)


def test_upsert_delete_and_replay(spark):
    base = table(spark, [("a", 1), ("b", 2), ("c", 3)])
    delta = table(spark, [("b", 20), ("d", 40)])
    as_map = lambda df: {r.key: r.v_int for r in df.collect()}
    assert as_map(build.upsert(base, delta)) == {"a": 1, "b": 20, "c": 3, "d": 40}
    gone = spark.createDataFrame([("a",), ("z",)], "key string")
    assert as_map(build.delete(base, gone)) == {"b": 2, "c": 3}
    journal = schema.entries(spark.createDataFrame([("a", 5, 1), ("a", 6, 2), ("b", 0, 3), ("e", 9, 4)], "k string, v int, s int"), F.col("k"), schema.int64(F.col("v")), F.col("s")).withColumn("deleted", F.col("key") == "b")
    assert as_map(build.replay(base, journal)) == {"a": 6, "c": 3, "e": 9}


def test_written_dictionaries_push_key_predicates_down(spark, tmp_path):
    path = str(tmp_path / "d")
    build.write(table(spark, NESTED.items()), path)
    again = build.read(spark, path)
    assert {r.key: r.v_int for r in again.collect()} == NESTED
    plan = search.prefix(again, "ab")._jdf.queryExecution().toString()
    assert "StringStartsWith(key,ab)" in plan
    assert "EqualTo(key,abc)" in lookup.get(again, "abc")._jdf.queryExecution().toString()


def test_batch_lookups_don_t_compare_all_pairs(spark):
    plan = lookup.lookup(table(spark, NESTED.items()), spark.createDataFrame([("a",)], "key string"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_text_and_numbers_of_values(spark):
    encoder = Encoder(spark).insert("a", 1).insert("b", "x").insert("c", b"\x01\xff").insert("d").insert("e", True).insert("f", 1.5)
    rows = encoder.entries().select("key", schema.text_of().alias("t"), schema.number_of().alias("n"), schema.kind_name(F.col("tag")).alias("k"), schema.json_of().alias("j")).collect()
    assert {r.key: r.t for r in rows} == {"a": "1", "b": "x", "c": "01FF", "d": "null", "e": "true", "f": "1.5"}
    assert {r.key: r.n for r in rows if r.n is not None} == {"a": 1.0, "f": 1.5}
    assert {r.key: r.k for r in rows} == {"a": "int", "b": "string", "c": "blob", "d": "null", "e": "bool", "f": "float64"}
    assert {r.key: r.j for r in rows} == {"a": "1", "b": '"x"', "c": "null", "d": "null", "e": "true", "f": "1.5"}


def test_lookups_in_one_of_several_dictionaries(spark):
    rows = spark.createDataFrame([("x", "a", 1), ("y", "a", 2), ("y", "b", 3)], "d string, k string, v long")
    built = schema.entries(rows, F.col("k"), schema.int64(F.col("v")), dict_id=F.col("d"))
    probes = spark.createDataFrame([("x", "a"), ("y", "a"), ("x", "b"), ("z", "a"), (None, "a"), ("y", None)], "dict_id string, key string")
    got = {(r.dict_id, r.key): (r.found, r.v_int) for r in lookup.lookup(built, probes).collect()}
    assert got == {("x", "a"): (True, 1), ("y", "a"): (True, 2), ("x", "b"): (False, None), ("z", "a"): (False, None), (None, "a"): (False, None), ("y", None): (False, None)}
    assert {(r.dict_id, r.key) for r in lookup.contains(built, probes).where("found").collect()} == {("x", "a"), ("y", "a")}
    assert lookup.present(built, probes).count() == 2 and lookup.missing(built, probes).count() == 4
    assert lookup.lookup(built, probes.select("key")).where("found").count() == 9


def test_metadata_survive_files(spark, tmp_path):
    rows = schema.entries(spark.createDataFrame([("a",)], "k string"), F.col("k"), schema.null())
    build.write(build.with_metadata(rows, {"author": "me", "version": 3}), f"{tmp_path}/d")
    assert build.metadata(build.read(spark, f"{tmp_path}/d")) == {"author": "me", "version": 3} and build.metadata(rows) == {}


def test_result_codes_have_texts(spark):
    got = [r[0] for r in spark.createDataFrame([(0,), (-13,), (-22,), (5,), (None,)], "c int").coalesce(1).select(schema.result_text(F.col("c"))).collect()]
    assert got == ["OK", "key not found", "JSON type mismatch", "unknown error", None] and len(schema.RESULTS) == 16


def test_an_opened_document(spark):
    json = Json(spark)
    handle = json.open(json.encode('{"a":{"b":[1,-2.5,null]},"s":"x","t":true}'))
    assert handle.lookup("a.b[1]") == (True, -2.5) and handle.lookup("a.b[2]") == (True, None) and handle.lookup("s") == (True, "x")
    assert handle.lookup("a") == (False, None) and handle.lookup("zz") == (False, None)
    assert dict(handle) == {"a.b[0]": 1, "a.b[1]": -2.5, "a.b[2]": None, "s": "x", "t": True} and len(handle) == 5
    assert handle.root_type() == "object" and json.open(json.encode("[1]")).root_type() == "array"
