"""The binary format: published sizes, round trips and damage."""

import random
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom import schema
from keyloom.cli import main
from keyloom.dictionary import Dictionary, Encoder
from keyloom.operators import analyze, build
from keyloom.sources import text as text_source
from keyloom.sources import fixtures, trie
from keyloom.sources.connector import TrieSource

SIZES = list(fixtures.GOLDEN.values())


@pytest.mark.parametrize("items,size", SIZES)
def test_published_sizes(items, size):
    items = {k.encode(): v for k, v in items.items()}
    content = trie.pack(items)
    assert len(content) == size
    assert [(k, t, v) for k, t, v in trie.unpack(content)] == [(k, *items[k]) for k in sorted(items)]


def test_random_dictionaries_survive():
    rng = random.Random(5)
    values = [(0, None), (1, True), (2, -(1 << 63)), (2, (1 << 63) - 1), (3, Decimal((1 << 64) - 1)), (4, 0.5), (5, 1e300), (6, "é東"), (6, ""), (7, b"\0\xff"), (7, b"")]
    for _ in range(200):
        items = {bytes(rng.choices(b"ab\0\xff", k=rng.randint(0, 7))): rng.choice(values) for _ in range(rng.randint(0, 40))}
        assert [(k, t, v) for k, t, v in trie.unpack(trie.pack(items))] == [(k, *items[k]) for k in sorted(items)]


def test_long_keys_and_wide_alphabets():
    assert trie.unpack(trie.pack({b"x" * 5000: (2, 1), b"x" * 4999 + b"y": (2, 2)}))[1][0].endswith(b"y")
    assert len(trie.unpack(trie.pack({bytes([b]): (0, None) for b in range(249)}))) == 249
    with pytest.raises(ValueError, match="249"):
        trie.pack({bytes([b]): (0, None) for b in range(250)})
    with pytest.raises(ValueError, match="bits"):
        trie.pack({b"abc": (0, None)}, 3)
    assert trie.unpack(trie.pack({b"abc": (0, None)}, 8)) == [(b"abc", 0, None)]
    with pytest.raises(ValueError, match="kind array"):
        trie.pack({b"a": (8, "[]")})


def test_every_flipped_bit_and_every_cut_is_noticed():
    content = trie.pack({f"key{i}".encode(): (3, i) for i in range(20)})
    for bit in range(8 * len(content)):
        bad = bytearray(content)
        bad[bit // 8] ^= 128 >> bit % 8
        with pytest.raises(trie.Corrupt):
            trie.unpack(bytes(bad))
    for n in range(len(content)):
        with pytest.raises(trie.Corrupt):
            trie.unpack(content[:n])


def test_unchecked_reading_ignores_the_checksum():
    content = bytearray(trie.pack({b"a": (2, 1)}))
    content[-1] ^= 1
    assert trie.unpack(bytes(content), verify=False) == [(b"a", 2, 1)]


def test_dictionaries_as_tables(spark):
    rows = [(f"d{i % 3}", f"k{i}", i) for i in range(30)]
    built = build.build(schema.entries(spark.createDataFrame(rows, "d string, k string, v int"), F.col("k"), schema.int64(F.col("v")), F.col("v"), F.col("d")))
    encoded = trie.encode(built)
    got = {(r.dict_id, r.key, r.v_int) for r in trie.decode(encoded).collect()}
    assert got == set(rows)
    head = trie.headers(encoded).orderBy("dict_id").first()
    assert head.magic and head.valid and head.num_keys == 10 and head.has_values and head.version_major == 1
    sizes = analyze.sizes(built, encoded).collect()
    assert all(r.keys == 10 and r.encoded_bytes > 40 for r in sizes)


def test_same_entries_in_any_order_give_same_bytes(spark):
    items = [(f"k{i % 7}", i) for i in range(20)]
    one = Encoder(spark)
    for k, v in items:
        one.insert(k, v)
    rows = one.rows[:]
    random.Random(1).shuffle(rows)
    again = Dictionary(build.build(spark.createDataFrame(rows, schema.ENTRY)))
    assert one.encode() == again.encode()


def test_the_data_source(spark, tmp_path):
    spark.dataSource.register(TrieSource)
    path = str(tmp_path / "tries")
    rows = [("one", "a", 1), ("one", "b", 2), ("two", "c", 3)]
    built = schema.entries(spark.createDataFrame(rows, "d string, k string, v int"), F.col("k"), schema.int64(F.col("v")), F.col("v"), F.col("d"))
    built.repartition("dict_id").write.format("keyloom").mode("append").save(path)
    again = spark.read.format("keyloom").load(path)
    assert {(r.dict_id, r.key, r.v_int) for r in again.collect()} == set(rows)
    assert trie.read(spark, path + "/*.trp").count() == 3


def test_the_command_line(spark, tmp_path, capsys):
    source, packed = tmp_path / "a.json", str(tmp_path / "a.trp")
    source.write_text('{"b":{"c":[1,2]},"a":"x"}')
    assert main(["encode", str(source), "-o", packed], spark) == 0
    assert main(["validate", packed], spark) == 0
    assert main(["info", packed], spark) == 0 and main(["dump", packed], spark) == 0
    capsys.readouterr()
    assert main(["get", packed, "b.c[1]"], spark) == 0
    assert capsys.readouterr().out == "b.c[1]\tint\t2\n"
    assert main(["search", packed, "b.c"], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 2
    assert main(["list", packed], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 4
    assert main(["get", packed, "zzz"], spark) == 3
    assert main(["decode", packed, "-o", str(tmp_path / "b.json")], spark) == 0
    assert (tmp_path / "b.json").read_text() == '{"a":"x","b":{"c":[1,2]}}'
    (tmp_path / "bad.trp").write_bytes(b"TRP\0" + b"\0" * 60)
    assert main(["validate", str(tmp_path / "bad.trp")], spark) == 2
    assert main(["info", str(tmp_path / "bad.trp")], spark) == 2
    assert main(["info", str(tmp_path / "none.trp")], spark) == 2
    assert main(["nonsense"], spark) == 1
    assert main(["fixtures", str(tmp_path / "golden")], spark) == 0
    assert {p.name.removesuffix(".trp"): p.stat().st_size for p in (tmp_path / "golden").iterdir()} == {k: size for k, (_, size) in fixtures.GOLDEN.items()}


def test_text_sources(spark, tmp_path):
    (tmp_path / "w.txt").write_bytes(b"apple\r\nbanana\n\ncherry")
    assert sorted(r.key for r in text_source.word_list(spark, str(tmp_path / "w.txt")).collect()) == ["apple", "banana", "cherry"]
    (tmp_path / "l.json").write_text('{"a":1}\n\n{"a":2}\n')
    assert text_source.json_lines(spark, str(tmp_path / "l.json")).count() == 2
    (row,) = text_source.json_files(spark, str(tmp_path / "l.json")).collect()
    assert row.json.count("\n") == 3 and row.doc_id.endswith("l.json")


class _Run:
    """A table that hands out the function that would be mapped over it."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_decoded_batches_hold_many_dictionaries(spark, monkeypatch):
    contents = [trie.pack({b"a": (2, i), b"b": (6, "x" * i), b"c": (0, None)}) for i in range(300)] + [trie.pack({}), None]
    files = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(302)]), pa.array(contents, pa.binary())], names=["dict_id", "content"])
    whole = list(trie.decode(_Run())([files]))
    assert len(whole) == 1 and whole[0].num_rows == 900
    monkeypatch.setattr(trie, "BATCH_ROWS", 100)
    parts = list(trie.decode(_Run())([files]))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches(whole)) and {p.num_rows for p in parts} == {102, 84}
    rows = whole[0].to_pylist()
    assert [r["v_int"] for r in rows[::3]] == list(range(300)) and rows[7] | {"tag": 6, "v_str": "xx", "seq": 1} == rows[7]
