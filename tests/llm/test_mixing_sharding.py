"""Rates and copies, and the permutation-filled table."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keyloom.llm import mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, n=2000):
    return spark.createDataFrame([(i, "a b c " * (1 + i % 3), "en", "big" if i % 10 else "small", 0) for i in range(n)], SCHEMA)


def test_rates_meet_the_weights(spark):
    docs = table(spark)
    rates = {r.source: (r.n_tokens, r.rate) for r in mixing.source_rates(docs, {"big": 1.0, "small": 1.0}).collect()}
    total = sum(t for t, _ in rates.values())
    assert all(abs(t * rate - total / 2) < 1 for t, rate in rates.values())
    emitted = mixing.mix(docs, {"big": 1.0, "small": 1.0}).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()
    assert all(abs(r.n - total / 2) < 0.1 * total for r in emitted)


def test_copies_are_floor_and_a_draw(spark):
    docs = table(spark, 300)
    rate = {r.source: r.rate for r in mixing.source_rates(docs, {"big": 0.3, "small": 0.7}).collect()}
    got = Counter(r.doc_id for r in mixing.mix(docs, {"big": 0.3, "small": 0.7}).collect())
    for r in docs.collect():
        draw = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
        whole = int(rate[r.source])
        assert got[r.doc_id] == whole + (draw < rate[r.source] - whole)


def test_the_mixture_is_the_same_however_it_is_partitioned(spark):
    docs = table(spark, 500)
    one, two = (sorted(map(tuple, mixing.mix(d).collect())) for d in (docs.repartition(1), docs.repartition(7)))
    assert one == two


def test_mixing_odd_rows(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, "x y", None, None, None), (None, "x y", None, None, None), (3, "w " * 200_000, "en", "b", 1), (3, "w " * 200_000, "en", "b", 1), (4, "v", "en", "b", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("copy", F.lit("c")).withColumn("__rate", F.lit(9)).withColumn("rate", F.lit(1)).withColumn("__n", F.lit(0))
    rates = {r.source: (r.n_docs, r.n_tokens, r.rate) for r in mixing.source_rates(docs).collect()}
    assert rates["a"] == (2, 0, 1.0) and rates[None][:2] == (2, 4) and rates["b"][:2] == (3, 400_001)
    out = mixing.mix(docs, copy_column=None)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect())[1] == 1
    assert mixing.mix(docs).columns == ["doc_id", "text", "lang", "source", "n_chars", "__rate", "rate", "__n", "copy"]
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r.source for r in mixing.mix(docs, {"b": 1.0}).collect()} == {"a", "b"}
    assert mixing.mix(docs, {}).where("source = 'b'").count() == 0


def test_every_slot_is_claimed_by_turns():
    shards = [f"s{i}" for i in range(7)]
    t = sharding.lookup_table(shards, 101)
    loads = Counter(t.tolist())
    assert len(loads) == 7 and max(loads.values()) - min(loads.values()) <= 1
    # by the definition: each shard in turn takes its next preferred free slot
    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    orders = [[(number("offset:" + s) + j * (number("skip:" + s) % 100 + 1)) % 101 for j in range(101)] for s in shards]
    taken = {}
    while len(taken) < 101:
        for i, order in enumerate(orders):
            if len(taken) < 101:
                taken[next(x for x in order if x not in taken)] = i
    assert [taken[x] for x in range(101)] == t.tolist()


def test_few_slots_move_when_a_shard_goes():
    shards = [f"s{i:02d}" for i in range(20)]
    before, after = sharding.lookup_table(shards, 2003), sharding.lookup_table(shards[:-1], 2003)
    moved = sum(a != b for a, b in zip(before, after) if a != 19)
    assert moved < 0.1 * 2003


@pytest.mark.parametrize("shards,size", [(["a"], 100), ([], 101), (["a", "a"], 101), ([str(i) for i in range(12)], 11)])
def test_bad_tables_are_refused(shards, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, size)


def test_placement(spark):
    rows = [(i, None if i % 2 else "t", "en", "s", 0) for i in range(3000)] + [(None, "x", None, None, None), (None, "y", None, None, None), (7, "z", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit(1)).withColumn("__slot", F.lit("x"))
    out = sharding.assign_shards(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "__slot", "slot", "shard"]
    got = out.collect()
    place = {}
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert r.slot == slot and place.setdefault(r.doc_id, r.shard) == r.shard
    assert len(got) == len(rows) and len(set(place.values())) == 128
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().toString()
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_columns_that_differ_in_case_are_replaced(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 0)], SCHEMA).withColumn("Shard", F.lit(1)).withColumn("SLOT", F.lit(2)).withColumn("Copy", F.lit(3))
    placed, mixed = sharding.assign_shards(docs), mixing.mix(docs)
    assert placed.columns == ["doc_id", "text", "lang", "source", "n_chars", "Copy", "slot", "shard"] and mixed.columns == ["doc_id", "text", "lang", "source", "n_chars", "Shard", "SLOT", "copy"]
    for name, df in (("placed", placed), ("mixed", mixed)):
        df.write.parquet(f"{tmp_path}/{name}")
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == 1
