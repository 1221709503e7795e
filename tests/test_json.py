"""Documents to leaves and back."""

import json
import os

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom import queries, schema
from keyloom.dictionary import Json
from keyloom.operators import analyze
from keyloom.operators import json_documents as J

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCUMENTS = {
    "roundtrip": '{"name":"keyloom","version":1,"features":["fast","compact","typed"],"config":{"max_depth":32,"crc":true}}',
    "siblings": '{"a":1,"ab":2,"b":3}',
    "long": '{"x":[0,1,2,3,4,5,6,7,8,9,10,11]}',
    "dotted": '{"a.b":1,"a":{"b":2}}',
    "empties": '{"o":{},"a":[],"n":[[],{},null]}',
    "matrix": '{"matrix":[[1,2],[3,4]]}',
    "types": '{"a":null,"b":true,"c":false,"d":42,"e":-7,"f":3.14,"g":"h\\u00e9 \\"q\\" \\ud83d\\ude00"}',
    "root array": "[1,[2],{}]",
    "empty": "{}",
    "empty array": "[]",
}


def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, json string")


def test_round_trip_of_known_documents(spark):
    back = {r.doc_id: json.loads(r.json) for r in J.unflatten(J.flatten(docs(spark, DOCUMENTS))).collect()}
    assert back == {k: json.loads(v) for k, v in DOCUMENTS.items()}


_json = st.recursive(st.none() | st.booleans() | st.integers(-(1 << 63), (1 << 64) - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=12) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=20)


@settings(max_examples=100, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_json, max_size=4) | st.dictionaries(st.text(max_size=4), _json, max_size=4))
def test_leaves_of_any_document(value):
    found = [(s, v if isinstance(v, (dict, list)) or v is None else J.typed(v)[2]) for s, v in J.leaves(json.dumps(value))[1]]
    assert J.assemble(found) == value
    quick = [(s, v if isinstance(v, (dict, list)) or v is None else J.typed(v)[2]) for s, v in J.quick_leaves(json.dumps(value))]
    assert quick == found


def test_types_and_paths(spark):
    text = '{"i":7,"n":-7,"u":9223372036854775808,"f":1.0,"e":1e2,"z":01,"s":"x","b":true,"l":[{"p":null}]}'
    rows = J.flatten(docs(spark, {"d": text})).select("path", schema.kind_name(F.col("tag")).alias("k"), schema.text_of().alias("t")).collect()
    assert {r.path: (r.k, r.t) for r in rows} == {"i": ("int", "7"), "n": ("int", "-7"), "u": ("uint", "9223372036854775808"), "f": ("float64", "1.0"), "e": ("float64", "100.0"), "z": ("int", "1"), "s": ("string", "x"), "b": ("bool", "true"), "l[0].p": ("null", "null")}


def test_integers_beyond_64_bits_are_held_at_the_limits():
    found = dict(J.leaves('{"a":99999999999999999999,"b":-99999999999999999999}')[1])
    assert J.typed(found[("a",)])[2] == (1 << 64) - 1 and J.typed(found[("b",)])[2] == -(1 << 63)


def test_the_last_of_equal_names_counts(spark):
    rows = J.flatten(docs(spark, {"d": '{"a":1,"b":2,"a":{"c":3}}'})).orderBy("seq").collect()
    assert [(r.path, r.v_int) for r in rows] == [("a.c", 3), ("b", 2)]


@pytest.mark.parametrize("text", ["1", '"x"', "null", "", "{", '{"a"}', '{"a":}', "[1,]", "[1 2]", '{"a":1', '{"a":"\\q"}', "{a:1}", "[tru]", "[NaN]", "[1,Infinity]"])
def test_what_is_no_document_raises(spark, text):
    for parse in (J.leaves, J.quick_leaves):
        with pytest.raises(J.SyntaxFault):
            parse(text)


def test_bad_documents_raise_or_are_skipped_or_listed(spark):
    deep = lambda n: '{"a":' * n + "1" + "}" * n
    some = docs(spark, {"good": "{}garbage", "bad": "{", "deep": deep(33), "limit": deep(32), "null": None})
    assert {r.doc_id for r in J.flatten(some, bad="skip").collect()} == {"good", "limit"}
    assert {(r.doc_id, r.fault) for r in J.faults(some).collect()} == {("bad", "syntax"), ("deep", "depth")}
    with pytest.raises(Exception, match="nested deeper"):
        J.flatten(some.where("doc_id = 'deep'")).collect()


def test_lookup_of_paths_tells_null_from_missing(spark):
    flat = J.flatten(docs(spark, {"d": DOCUMENTS["empties"], "e": '{"o":1}'}))
    got = {(r.doc_id, r.path): (r.found, r.tag) for r in J.lookup_paths(flat, spark.createDataFrame([("n[2]",), ("n",), ("o",)], "path string")).collect()}
    assert got == {("d", "n[2]"): (True, 0), ("d", "n"): (False, None), ("d", "o"): (True, 9), ("e", "n[2]"): (False, None), ("e", "n"): (False, None), ("e", "o"): (True, 2)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_of_paths_reads_the_leaves_once_and_broadcasts_none(spark, monkeypatch):
    d = docs(spark, {**DOCUMENTS, "other": '{"o":1}', "twice": '{"a.b":1,"a":{"b":2},"x":3}'})
    paths = spark.createDataFrame([(p,) for p in ("n[2]", "n", "o", "a.b", "", None, "o")], "path string")
    found = J.lookup_paths(J.flatten(d), paths)
    plan = plan_of(found)
    assert plan.count("MapInArrow run") == 1 and "SortMergeJoin" not in plan
    assert all("MapInArrow" not in broadcast.split("FileScan")[0].split("Scan ExistingRDD")[0] for broadcast in plan.split("BroadcastExchange")[1:])
    got = sorted(map(str, found.collect()))
    want = []
    for name, text in [(r.doc_id, r.json) for r in d.collect()]:
        leaves = [(J.path_text(s), J.typed(v)) for s, v in J.leaves(text)[1]]
        for p in ("n[2]", "n", "o", "a.b", "", None):
            hits = [t for q, t in leaves if q == p]
            want += [(name, p, True, t[0], None if t[2] is None else str(t[2])) for t in hits] or [(name, p, False, None, None)]
    plain = [(r.doc_id, r.path, r.found, r.tag, next((str(r[c]) for c in schema.COLUMNS if r[c] is not None), None)) for r in found.collect()]
    assert sorted(map(str, plain)) == sorted(map(str, want))
    monkeypatch.setattr(J, "collect_bounded", lambda df: None)
    assert sorted(map(str, J.lookup_paths(J.flatten(d), paths).collect())) == got


def test_orders_are_not_broadcast_for_their_documents(spark):
    plan = plan_of(queries.QUERIES["json_lookup_paths"](spark, DATA))
    assert "SortMergeJoin [o_orderkey" in plan and plan.count("FileScan") == 2


def test_paths_types_and_counts_in_the_jvm(spark):
    c = F.col("json")
    rows = docs(spark, DOCUMENTS | {"scalar": "1", "broken": "{"}).select("doc_id", J.root_type(c).alias("root"), J.count_top_level(c).alias("n"), J.at_path(c, "config.max_depth", "int").alias("depth"), J.has_path(c, "a").alias("has"), J.at_path(c, "matrix[1]").alias("sub")).collect()
    by = {r.doc_id: r for r in rows}
    assert by["roundtrip"].root == "object" and by["roundtrip"].n == 4 and by["roundtrip"].depth == 32
    assert by["root array"].root == "array" and by["root array"].n == 3 and by["scalar"].root is None and by["broken"].root is None
    assert by["types"].has and not by["matrix"].has and by["matrix"].sub == "[3,4]"
    members = {(r.key, r.value) for r in J.members(docs(spark, {"d": DOCUMENTS["siblings"]})).collect()}
    assert members == {("a", "1"), ("ab", "2"), ("b", "3")}


def test_empty_containers_can_be_dropped(spark):
    assert [r.path for r in J.flatten(docs(spark, {"d": DOCUMENTS["empties"]}), keep_empty=False).collect()] == ["n[2]"]


def test_pretty_text(spark):
    flat = J.flatten(docs(spark, {"d": '{"a":[1]}'}))
    assert J.unflatten(flat, indent="\t").first().json == '{\n\t"a": [\n\t\t1\n\t]\n}'


@pytest.mark.parametrize("text", ['{"a":1,"ab":2,"b":{"c":[true,null,"x",1.5,-3]}}', "{}", "[]", '{"x":[0,1,2,3,4,5,6,7,8,9,10,11]}', '[{"a":1},2]'])
def test_documents_in_the_binary_format(spark, text):
    codec = Json(spark)
    assert json.loads(codec.decode(codec.encode(text))) == json.loads(text)


def test_a_generated_catalogue_survives(spark):
    catalogue = analyze.catalog(spark, 15)
    back = J.unflatten(J.flatten(catalogue)).first().json
    assert json.loads(back) == json.loads(catalogue.first().json) and len(json.loads(back)["products"]) == 15


def test_numbers_and_strings_that_no_type_holds(spark):
    digits = "9" * 5000
    texts = {"long": f'{{"a":{digits},"b":-{digits},"z":{"0" * 5000}7}}', "float": '{"a":1e400,"b":-1e400,"c":[1e400]}', "half": '{"a":"\\ud800"}', "name": '{"\\udc00x":1}', "pair": '{"a":"\\ud83d\\ude00"}'}
    rows = J.flatten(docs(spark, texts), bad="skip").select("doc_id", "path", schema.text_of().alias("t")).collect()
    got = {(r.doc_id, r.path): r.t for r in rows}
    assert got["long", "a"] == str((1 << 64) - 1) and got["long", "b"] == str(-(1 << 63)) and got["long", "z"] == "7"
    assert {k[0] for k in got} == {"long", "float", "pair"} and got["pair", "a"] == "\U0001f600"
    assert {r.doc_id: r.fault for r in J.faults(docs(spark, texts)).collect()} == {"half": "syntax", "name": "syntax"}
    with pytest.raises(Exception, match="document half"):
        J.flatten(docs(spark, {"half": texts["half"]})).collect()
    back = {r.doc_id: json.loads(r.json, parse_constant=lambda _: 1 / 0) for r in J.unflatten(J.flatten(docs(spark, texts), bad="skip")).collect()}
    assert back["float"]["a"] == -back["float"]["b"] == back["float"]["c"][0] > 1e308


def test_infinities_of_entries_are_null(spark):
    flat = J.flatten(docs(spark, {"d": '{"a":1.5,"b":2.5}'})).withColumn("v_f64", F.when(F.col("path") == "a", F.lit(float("inf"))).otherwise(F.col("v_f64")))
    assert json.loads(J.unflatten(flat).first().json) == {"a": None, "b": 2.5}


def test_paths_with_quotes(spark):
    df = docs(spark, {"d": json.dumps({"it's": 1, 'q"q': {"b": [5]}, "b'\"": 2})})
    paths = ["it's", 'q"q.b[0]', "b'\""]
    row = df.select(*[J.at_path(F.col("json"), p).alias(f"p{i}") for i, p in enumerate(paths)], *[J.has_path(F.col("json"), p).alias(f"h{i}") for i, p in enumerate(paths)]).first()
    assert row[:3] == ("1", "5", "2") and all(row[3:])


def test_rows_are_the_leaves_whichever_parser_reads_them(spark):
    """Documents that Python's decoder takes and ones that it refuses, faults among them, in one batch."""
    texts = {**DOCUMENTS, "zeros": '{"a":[01,{"b":002.5}],"c":{}}', "deep": "[" * 40 + "]" * 40, "part": '{"ok":1,"a":[1,2,', "big": '{"u":18446744073709551615,"v":-99999999999999999999,"w":[[[]]]}'}
    for keep in (True, False):
        got = {}
        for r in J.flatten(docs(spark, texts).coalesce(1), keep_empty=keep, bad="skip").collect():
            got.setdefault(r.doc_id, []).append((r.seq, r.path, tuple(x.name if x.idx is None else x.idx for x in r.segments), r.tag, next((r[c] for c in schema.COLUMNS if r[c] is not None), None)))
        want = {}
        for name, text in texts.items():
            try:
                found = J.leaves(text)[1]
            except (J.SyntaxFault, J.DepthFault):
                continue
            found = [(s, v) for s, v in found if keep or not s or not isinstance(v, (dict, list))]
            rows = [(i, J.path_text(s), s, J.typed(v)[0], J.typed(v)[2]) for i, (s, v) in enumerate(found)]
            if rows:
                want[name] = rows
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and "deep" not in got and "part" not in got


def test_leaves_of_entries_are_read_once(spark):
    d = docs(spark, DOCUMENTS)
    entries = J.to_entries(J.flatten(d.where("doc_id not in ('dotted', 'empties', 'root array')")), d)
    back = {r.doc_id: json.loads(r.json) for r in J.unflatten(J.from_entries(entries)).collect()}
    assert {k: back[k] for k in DOCUMENTS if k not in ("dotted", "empties", "root array")} == {k: json.loads(v) for k, v in DOCUMENTS.items() if k not in ("dotted", "empties", "root array")}
    assert back["dotted"] == back["empties"] == {} and back["root array"] == []
    found = J.from_entries(entries)
    assert {(r.doc_id, r.path, r.seq, r.tag, r.v_str) for r in found.where("size(segments) = 0").collect()} == {("empty", "", 0, 9, "{}"), ("empty array", "", 0, 8, "[]"), ("dotted", "", 0, 9, "{}"), ("empties", "", 0, 9, "{}"), ("root array", "", 0, 8, "[]")}
    plan = plan_of(queries.QUERIES["json_binary_roundtrip"](spark, DATA))
    assert plan.count("MapInArrow run") == 4 and "Join" not in plan


def test_documents_are_rebuilt_without_a_shuffle(spark):
    texts = {**DOCUMENTS, "zeros": '{"a":[01,{"b":002.5}],"c":{}}', "deep": "[" * 40 + "]" * 40, "part": '{"ok":1,"a":[1,2,', "null": None}
    d = docs(spark, texts)
    by_leaves = {r.doc_id: r.json for r in J.unflatten(J.flatten(d, bad="skip")).collect()}
    found = J.rebuilt(d.repartition(1), bad="skip")
    assert {r.doc_id: r.json for r in found.collect()} == by_leaves and set(by_leaves) == set(texts) - {"deep", "part", "null"}
    assert "hashpartitioning" not in plan_of(J.rebuilt(d))
    twice = [(r.doc_id, r.json) for r in J.rebuilt(spark.createDataFrame([("d", '{"a":1}'), ("d", '{"a":2}')], "doc_id string, json string").coalesce(1)).collect()]
    assert twice == [("d", '{"a":1}'), ("d", '{"a":2}')]
    plan = plan_of(queries.QUERIES["json_roundtrip"](spark, DATA))
    assert "hashpartitioning(doc_id" not in plan


def test_leaves_are_gathered_a_document_a_row_before_the_shuffle(spark):
    flat = J.flatten(docs(spark, DOCUMENTS))
    before = plan_of(J.unflatten(flat)).split("Exchange")[1]
    assert before.index("partial_collect_list") < before.index("MapInArrow _together") < before.index("MapInArrow run")
    scattered = J.unflatten(flat.repartition(3, "path").orderBy(F.rand(1)))
    assert {r.doc_id: r.json for r in scattered.collect()} == {r.doc_id: r.json for r in J.unflatten(flat).collect()}


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.lists(st.sampled_from(["a", "b", "", 0, 1, 11]), max_size=3).map(tuple), st.none() | st.integers(0, 3) | st.builds(dict) | st.builds(list)), max_size=6))
def test_any_leaves_assemble_alike(items):
    """Also where leaves repeat, stand in each other's way, or mix names and indexes."""
    steps, ends = [x for s, _ in items for x in s], [0]
    for s, _ in items:
        ends.append(ends[-1] + len(s))
    got = J._assembled(steps, ends, [v for _, v in items], range(len(items)))
    want = J.assemble(items)
    assert json.dumps(got) == json.dumps(want)


def test_paths_are_forgotten_when_there_are_too_many(spark, monkeypatch):
    texts = {str(i): json.dumps({f"k{i}": [i, {"x": i}], "": {"y": i}}) for i in range(200)}
    table = pa.RecordBatch.from_arrays([pa.array(list(texts)), pa.array(list(texts.values()))], names=["doc_id", "json"])
    parts = [table.slice(i, 20) for i in range(0, 200, 20)]
    want = pa.Table.from_batches(J._flat(iter(parts), 32, True, "error"))
    monkeypatch.setattr(J, "MAX_PATHS", 30)
    assert pa.Table.from_batches(J._flat(iter(parts), 32, True, "error")).equals(want)
    assert want.column("path").to_pylist()[3:6] == ["k1[0]", "k1[1].x", ".y"]


def test_leaves_are_counted_in_one_map(spark):
    texts = {**DOCUMENTS, "zeros": '{"a":[01,{"b":002.5}],"c":{}}', "same": '{"a":1,"a":[1,2]}', "comma": '{"a":"x,y","b":[",",[]]} , ,', "deep": "[" * 40 + "]" * 40, "limit": "[" * 32 + "]" * 32, "part": '{"ok":1,"a":[1,2,', "null": None}
    d = docs(spark, texts)
    want = {r.doc_id: r.leaves for r in J.count_leaves(J.flatten(d, bad="skip")).collect()}
    assert {r.doc_id: (r.json, r.leaves) for r in J.with_leaf_counts(d, bad="skip").collect()} == {k: (texts[k], n) for k, n in want.items()} and want["comma"] == 3
    with pytest.raises(Exception, match="nested deeper"):
        J.with_leaf_counts(d.where("doc_id = 'deep'")).collect()
    plan = plan_of(queries.QUERIES["json_counts"](spark, DATA))
    assert plan.count("MapInArrow run") == 1 and plan.count("FileScan") == 2 and "hashpartitioning(doc_id" not in plan


def test_root_types_are_those_of_the_parser(spark):
    """The first character tells the type only where the parser takes the text."""
    texts = [t for v in DOCUMENTS.values() for t in (v, f" \t\r\n{v}\n")] + ["", " ", "1", '"{"', "null", "{", "[", "[1,]", '{"a":1,"a":2}', "\ufeff{}", "\u00a0{}", "\x0b[]", "/**/{}", "{}x", "[] {}", "{'a':1}", "]", None]
    c = F.col("json")
    shape = F.schema_of_variant(F.try_parse_json(c))
    want = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, json string").select("json", J.root_type(c).alias("got"), want.alias("want")).collect()
    assert [(r.json, r.got) for r in rows] == [(r.json, r.want) for r in rows] and {r.got for r in rows} == {None, "object", "array"}
