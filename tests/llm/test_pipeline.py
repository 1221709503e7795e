"""The pipeline's stages on planted cases, and the queries against their SQL."""

import hashlib
import os
import random

import duckdb
import pytest
import test_decontaminate
import test_toxicity

import __spark_entry__
import corpus_pipeline
from keyloom.llm import decontaminate, minhash, mixing, queries, sharding, toxicity

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Tables with toxic documents, copies and benchmark passages, and the ids of each."""
    rng = random.Random(8)
    words = ["".join(rng.choices("bcdfglmnprst", k=6)) for _ in range(4000)]
    insults = ["idiot", "moron", "scum", "trash"]
    item = " ".join(rng.choices(words, k=20))
    rows, toxic, copies, leaks = [], set(), {}, set()
    for i in range(400):
        text = rng.choices(words, k=80)
        if i % 8 == 0:
            toxic.add(i)
            for w in rng.sample(insults, 3):
                text.insert(rng.randrange(80), w)
        elif i % 50 == 1:
            leaks.add(i)
            text[10:10] = [item]
        elif i % 50 == 2:
            copies[1000 + i] = i
            rows.append((1000 + i, " ".join(text[:-1]), "en", "s1", 0))
        rows.append((i, " ".join(text), "en", f"s{i % 2}", 0))
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, toxic, copies, leaks


def test_stages_and_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]


def test_every_stage_does_its_work_on_what_the_last_one_kept(spark, planted):
    path, rows, toxic, copies, leaks = planted
    docs = spark.read.parquet(f"{path}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    first, second, third, fourth, fifth = (f for _, f in corpus_pipeline.STAGES)
    kept = first(spark, docs, path).cache()
    assert ids(kept) == sorted(r[0] for r in rows if r[0] not in toxic) and kept.schema == docs.schema
    one = second(spark, kept, path).cache()
    assert ids(one) == sorted(r[0] for r in rows if r[0] not in toxic and r[0] not in copies) and one.columns == docs.columns
    clean = third(spark, one, path).cache()
    assert ids(clean) == sorted(set(ids(one)) - leaks) and clean.columns == docs.columns
    mixed = fourth(spark, clean, path).cache()
    assert ids(mixed) == ids(mixing.mix(clean)) and mixed.columns == docs.columns
    placed = fifth(spark, mixed, path)
    assert placed.columns == [*docs.columns, "shard"] and ids(placed) == ids(mixed)
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) == sorted(map(tuple, placed.collect()))


@pytest.mark.parametrize("empty", [{"documents"}, {"labels", "benchmark"}, {"documents", "labels", "benchmark"}])
def test_empty_tables(spark, planted, tmp_path, empty):
    path, rows, *_ = planted
    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{path}/{t}.parquet")
        (df.limit(0) if t in empty else df).write.parquet(f"{tmp_path}/{t}.parquet")
    n = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert n == 0 if "documents" in empty else n > 0


def test_nulls_and_columns_of_their_own(spark, planted, tmp_path):
    path, *_ = planted
    odd = spark.createDataFrame([(None, None, None, None, None), (5000, None, "en", "s0", 0), (5001, "", "en", None, 0), (5002, "w " * 100_000, "en", "s0", 0), (5002, "w " * 100_000, "en", "s0", 0)], SCHEMA)
    docs = spark.read.parquet(f"{path}/documents.parquet").unionByName(odd).selectExpr("*", "1 AS key", "2 AS shard_", "'x' AS copy", "3 AS rate")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "shard"] and out.count() > 0


def test_the_pipeline_is_what_brute_force_gives(spark, tmp_path):
    """All stages by dictionaries and sets, on texts whose similarities are far from the thresholds."""
    rng = random.Random(12)
    words = ["".join(rng.choices("bcdfglmnprst", k=6)) for _ in range(3000)]
    insults = ["idiot", "moron", "scum", "trash", "loser"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25) if i else 2))) for i in range(6)]
    rows, labels = [], []
    for i in range(500):
        text = rng.choices(words, k=70)
        if i % 6 == 0:
            text[5:5] = rng.sample(insults, 3)
            text[40:40] = rng.sample(insults, 2)
        elif i % 25 == 1:
            text[10:10] = rng.choice(items)[1].split()
        rows.append((i, " ".join(text), "en", f"s{i % 3}", 0))
        if i % 3 == 0:
            labels.append((i, 1, int(i % 6 == 0)))
        if i % 20 == 7:
            rows += [(5000 + i, rows[-1][1], "en", "s2", 0), (6000 + i, " ".join(text[2:]), "en", "s1", 0)]
    rows += [(None, "", None, None, None), (9000, None, "en", "s0", 0), rows[3]]
    for name, data, schema in (("documents", rows, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    # toxicity
    _, _, toxic = test_toxicity.brute_force([r for r in rows if r[1] and r[0] is not None], labels)
    docs = [r for r in rows if r[0] not in toxic]
    assert len(toxic) > 70
    # near-duplicates: components of pairs by the similarity of their shingles
    shingles = [{tuple(t[k : k + 3]) for k in range(len(t) - 2)} for t in ((r[1] or "").split() for r in docs)]
    root = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            union = len(shingles[a] | shingles[b])
            if union and len(shingles[a] & shingles[b]) / union >= 0.5:
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(docs[i])
    docs = [min(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in groups.values()]
    # decontamination
    leaks = {d for d, _ in test_decontaminate.brute([(k, r[1]) for k, r in enumerate(docs)], items)}
    docs = [r for k, r in enumerate(docs) if k not in leaks]
    assert leaks
    # mixing
    tokens = {}
    for r in docs:
        tokens[r[3]] = tokens.get(r[3], 0) + len((r[1] or "").split())
    weight = {s: n**mixing.ALPHA if n else 0 for s, n in tokens.items()}
    rate = {s: round(sum(tokens.values()) * weight[s] / sum(weight.values()) / n, 6) if n else 1.0 for s, n in tokens.items()}
    table, want = sharding.lookup_table(sharding.SHARDS), []
    for r in docs:
        name = "" if r[0] is None else str(r[0])
        draw = int(hashlib.md5(f"{mixing.SEED}:{name}".encode()).hexdigest()[:13], 16) / (1 << 52)
        slot = int(hashlib.md5(name.encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        want += [(*r, sharding.SHARDS[table[slot]])] * (int(rate[r[3]]) + (draw < rate[r[3]] % 1))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 300


def test_names_and_sql():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_what_sql_gives(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_over_the_whole_table(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_modules_take_their_place():
    assert all(m.__doc__ for m in (decontaminate, minhash, mixing, queries, sharding, toxicity))
