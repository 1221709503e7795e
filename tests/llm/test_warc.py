"""The salvage reader: round trips, every kind of damage, and splits."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from keyloom.llm import warc as W

SCHEMA = "page_id long, url string, html string"


def members(n, seed=0):
    rng = random.Random(seed)
    return [W.record(i, f"http://x/{i}", f"<p>{rng.random()}</p>" * rng.randint(0, 30)) for i in range(n)]


def read(data, *bounds):
    rows = list(W.salvage(lambda at, n: data[at : at + n], len(data), *bounds))
    return [r[4]["warc-record-id"] for r in rows if r[2] == "record"], rows


def ids(*numbers):
    return [f"<urn:page:{i}>" for i in numbers]


@pytest.mark.parametrize("pack", [W.compressed, bytes])
def test_whole_files(pack):
    found, rows = read(b"".join(pack(m) for m in members(20)))
    assert found == ids(*range(20)) and [r[2] for r in rows if r[2] != "record"] == ["end"]


@pytest.mark.parametrize("pack", [W.compressed, bytes])
@pytest.mark.parametrize("damage", ["flip", "cut", "insert", "zero"])
def test_records_after_damage_are_recovered(pack, damage):
    rng = random.Random(damage)
    for hurt in (0, 3, 9):
        parts = [pack(m) for m in members(10, hurt)]
        part = bytearray(parts[hurt])
        at = rng.randrange(20, len(part))
        if damage == "flip":
            part[at] ^= 0x10
        elif damage == "cut":
            del part[at:]
        elif damage == "zero":
            part[at : at + 5] = b"\0" * len(part[at : at + 5])
        else:
            part[:0] = rng.randbytes(50)
        parts[hurt] = bytes(part)
        found, _ = read(b"".join(parts))
        assert [x for x in found if x != ids(hurt)[0]] == ids(*(i for i in range(10) if i != hurt))
        if damage == "insert":
            assert found == ids(*range(10))


def test_checks_of_a_record():
    good = W.record(1, None, "hello")
    for bad in (good.replace(b"WARC/1.0", b"WORC/1.0"), good.replace(b"hello", b"jello"), good.replace(b"Content-Length: 5", b"Content-Length: 4"), good.replace(b"Content-Length: 5", b"Content-Length: x"), good[:-1], good.replace(b"WARC-Type", b"WARC Type\r\nno colon")):
        assert read(W.compressed(bad))[0] == [] and read(bad)[0] == []
    assert read(W.compressed(good + good))[0] == ids(1, 1)
    sha = W.record(1, None, "hello").replace(b"sha1:", b"unknown:")
    assert read(sha)[0] == ids(1)


def test_members_that_are_no_records_are_passed_over():
    import gzip

    data = gzip.compress(b"nothing of the kind") + W.compressed(members(1)[0])
    found, rows = read(data)
    assert found == ids(0) and rows[0][3] == "no version line"


def test_stretches_cover_a_file_once():
    data = b"".join(W.compressed(m) for m in members(60))
    for step in (37, 500, 4000):
        found = [x for lo in range(0, len(data), step) for x in read(data, lo, lo + step)[0]]
        assert found == ids(*range(60))


def pages(spark, n=300):
    rng = random.Random(4)
    return spark.createDataFrame([(i, f"http://x/{i}", f"<html>{rng.random()}</html>" * rng.randint(1, 50)) for i in range(n)], SCHEMA)


def test_all_pages_but_the_spoilt_ones(spark):
    table = pages(spark)
    kind = F.pmod("page_id", F.lit(7))
    damage = F.when(kind == 1, W.FLIP).when(kind == 2, W.TRUNCATE).when(kind == 3, W.GARBAGE)
    archives = W.pack(table, damage, archive_bytes=20_000).cache()
    assert archives.count() > 5
    rows = W.from_table(archives)
    got = W.salvaged(W.measured(rows)).collect()
    want = {(r.page_id, r.url, hashlib.md5(r.html.encode()).hexdigest()) for r in table.collect() if r.page_id % 7 not in (1, 2)}
    assert {(r.page_id, r.url, r.digest) for r in got if r.kind == "record"} == want
    # records and gaps cover each file exactly
    size = {r.path: len(r.content) for r in archives.collect()}
    for path, n in size.items():
        parts = sorted((r.offset, r.end) for r in got if r.path == path)
        assert parts[0][0] == 0 and parts[-1][1] == n and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert all(r.reason and r.n_bytes == r.end - r.offset for r in got if r.kind == "gap")


def test_files_are_read_by_splits(spark, tmp_path):
    table = pages(spark, 200)
    for r in W.pack(table, archive_bytes=40_000).collect():
        (tmp_path / r.path).write_bytes(r.content)
    (tmp_path / "plain.warc").write_bytes(b"".join(members(5)) + b"rubbish at the end")
    rows = W.from_files(spark, str(tmp_path), split_bytes=3000).cache()
    assert rows.where("kind = 'record' and path like '%.gz'").count() == 200
    assert rows.where("kind = 'record' and path not like '%.gz'").count() == 5
    (gap,) = W.gaps(rows).collect()
    assert gap.end - gap.offset == 18 and gap.path.endswith("plain.warc") and gap.reason == "garbage"


def test_odd_rows(spark):
    table = spark.createDataFrame([(None, None, None), (1, "u\r\nv", ""), (2, "u", "x" * 3_000_000), (3, "u", "é"), (3, "u", "é")], SCHEMA).withColumn("file", F.lit(1)).withColumn("damage", F.lit("d"))
    got = W.salvaged(W.measured(W.from_table(W.pack(table)))).collect()
    assert sorted((r.page_id or -1, r.n_bytes) for r in got) == [(-1, 0), (1, 0), (2, 3_000_000), (3, 2), (3, 2)]
    files = spark.createDataFrame([("a", None), ("b", bytearray()), ("c", bytearray(b"\x1f\x8b\x08")), (None, bytearray(b"junk"))], "path string, content binary")
    rows = W.from_table(files)
    assert rows.where("kind = 'record'").count() == 0
    assert {(r.path, r.offset, r.end, r.reason) for r in W.gaps(rows).collect()} >= {("c", 0, 3, "truncated")}
    assert W.from_table(files.limit(0)).count() == 0 and W.pack(table.limit(0)).count() == 0


@pytest.mark.parametrize("length", ["²", "9" * 5000, "-1", "1_0", "9" * 18, str(W.MAX_BLOCK + 1)])
@pytest.mark.parametrize("pack", [W.compressed, bytes])
def test_damaged_lengths_lose_one_record(pack, length):
    parts = members(5)
    parts[2] = W.record(2, None, "hello").replace(b"Content-Length: 5", b"Content-Length: " + length.encode())
    found, rows = read(b"".join(pack(m) for m in parts))
    assert found == ids(0, 1, 3, 4) and any(r[2] == "failure" for r in rows)


def test_a_block_is_not_read_before_its_end_is_checked():
    data = members(1)[0].replace(b"Content-Length: ", b"Content-Length: 9") + b"x" * 100
    asked = []
    rows = list(W.salvage(lambda at, n: (asked.append(n), data[at : at + n])[1], len(data)))
    assert max(asked) <= W.PIECE and rows[0][2] == "failure"


def test_records_before_the_damage_of_a_member_are_recovered():
    parts = members(6, 4)
    data = bytearray(W.compressed(b"".join(parts[:4])))
    del data[-30:]
    found, rows = read(bytes(data) + W.compressed(parts[5]))
    assert found[:1] == ids(0) and found[-1:] == ids(5) and len(found) >= 3
    assert all(r[3].startswith("before damage") and r[0] == r[1] for r in rows if r[2] == "record" and r[0] == 0)
    # without a digest nothing proves a record
    bare = [p.replace(b"WARC-Block-Digest", b"X-None") for p in parts[:4]]
    assert read(W.compressed(b"".join(bare))[:-30] + W.compressed(parts[5]))[0] == ids(5)
