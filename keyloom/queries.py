"""The queries of the dictionary engine over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom import schema
from keyloom.functions import bits
from keyloom.operators import analyze, build, lookup, search
from keyloom.operators import json_documents as documents
from keyloom.plans.lineage import cut
from keyloom.plans.sizing import small_side
from keyloom.schema import entries
from keyloom.sources import fixtures, trie

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, column: str, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.build(entries(_table(spark, sf_dir, "nation"), F.col("n_name"), schema.uint64(F.col("n_nationkey")), F.col("n_nationkey"), F.lit("nation")))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of every event type and user."""
    e = _table(spark, sf_dir, "events")
    return build.build(entries(e, F.concat_ws(":", "event_type", "user_id"), schema.float64(F.col("value")), F.col("event_id"), F.lit("events")))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(_table(spark, sf_dir, "customer"), F.col("c_name"), schema.float64(F.col("c_acctbal")), F.col("c_custkey"), F.lit("customer"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest price of every part name."""
    p = _table(spark, sf_dir, "part").groupBy("p_name").agg(F.max("p_retailprice").alias("price"))
    return entries(p, F.col("p_name"), schema.float64(F.col("price")), dict_id=F.lit("part"))


@query("""SELECT event_type || ':' || user_id AS key, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY 1""")
def dict_build_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("key", F.col("v_f64").alias("value"), "seq")


@query("""
WITH probes(key) AS (VALUES ('NATION_1'), ('NATION_10'), ('NATION_'), ('NATION_99'), ('nation_1'), (''))
SELECT key, n_name IS NOT NULL AS found, n_nationkey::BIGINT AS value FROM probes LEFT JOIN nation ON key = n_name""")
def dict_lookup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = _rows(spark, "key", ["NATION_1", "NATION_10", "NATION_", "NATION_99", "nation_1", ""])
    return lookup.lookup(_nations(spark, sf_dir), probes).select("key", "found", F.col("v_uint").cast("bigint").alias("value"))


@query("""SELECT l_orderkey, l_linenumber, o_orderkey IS NOT NULL AS found, o_totalprice AS value
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def dict_lookup_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item looks its order up, in a dictionary of all orders."""
    o = _table(spark, sf_dir, "orders")
    orders = entries(o, F.col("o_orderkey").cast("string"), schema.float64(F.col("o_totalprice")), dict_id=F.lit("orders"))
    probes = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("key"))
    return lookup.lookup(orders, probes).select("l_orderkey", "l_linenumber", "found", F.col("v_f64").alias("value"))


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS found FROM customer""")
def dict_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = build.build(entries(_table(spark, sf_dir, "orders"), F.col("o_custkey").cast("string"), schema.null()))
    probes = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("key"))
    return lookup.contains(keys, probes).select("c_custkey", "found")


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def dict_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = entries(_table(spark, sf_dir, "orders"), F.col("o_custkey").cast("string"), schema.null())
    return lookup.present(keys, _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("key"))).select("c_custkey")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def dict_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = entries(_table(spark, sf_dir, "orders"), F.col("o_custkey").cast("string"), schema.null())
    return lookup.missing(keys, _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("key"))).select("c_custkey")


@query("""SELECT n_name AS key, n_nationkey::BIGINT AS value FROM nation WHERE n_name = 'NATION_7'""")
def dict_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.get(_nations(spark, sf_dir), "NATION_7").select("key", F.col("v_uint").cast("bigint").alias("value"))


@query("""SELECT count(*) AS added, count(DISTINCT event_type || ':' || user_id) AS keys FROM events""")
def dict_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    raw = entries(e, F.concat_ws(":", "event_type", "user_id"), schema.float64(F.col("value")), F.col("event_id"))
    return raw.agg(F.count(F.lit(1)).alias("added"), F.count_distinct("key").alias("keys"))


@query("""
WITH k AS (SELECT DISTINCT p_name FROM part),
     b AS (SELECT DISTINCT substr(p_name, i::INT, 1) AS c FROM k, unnest(range(1, length(p_name) + 1)) AS u(i)),
     s AS (SELECT count(*) AS symbols FROM b)
SELECT (SELECT count(*) FROM k) AS num_keys, (SELECT sum(strlen(p_name))::BIGINT FROM k) AS key_bytes, true AS has_values, symbols,
       length(bin(symbols + 5)) AS bits_per_symbol FROM s""")
def dict_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.info(_parts(spark, sf_dir)).select("num_keys", "key_bytes", "has_values", "symbols", "bits_per_symbol")


@query("""SELECT c_name AS key, c_acctbal AS value FROM customer ORDER BY c_name""")
def dict_scan_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scan(_customers(spark, sf_dir)).select("key", F.col("v_f64").alias("value"))


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS value FROM orders
UNION ALL SELECT -o_orderkey, 0 FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey > 0""")
def dict_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    base = entries(o, F.col("o_orderkey").cast("string"), schema.float64(F.col("o_totalprice")))
    changed = entries(o.where("o_orderkey % 3 = 0"), F.col("o_orderkey").cast("string"), schema.float64(F.col("o_totalprice") * 2))
    new = entries(o.where("o_orderkey % 7 = 0 and o_orderkey > 0"), (-F.col("o_orderkey")).cast("string"), schema.float64(F.lit(0.0)))
    return build.upsert(base, build.add(changed, new)).select(F.col("key").cast("bigint").alias("key"), F.col("v_f64").alias("value"))


@query("""SELECT o_orderkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def dict_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    gone = o.join(_table(spark, sf_dir, "customer").where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    kept = build.delete(entries(o, F.col("o_orderkey").cast("string"), schema.null()), gone.select(F.col("o_orderkey").cast("string").alias("key")))
    return kept.select(F.col("key").cast("bigint").alias("key"))


@query("""
WITH last AS (SELECT o_custkey, max(o_orderkey) AS o FROM orders GROUP BY 1)
SELECT c_custkey AS key, coalesce(o, 0) AS value FROM customer LEFT JOIN last ON o_custkey = c_custkey WHERE o IS NULL OR o % 4 <> 0""")
def dict_replay_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with 0, after a journal with an entry for every order, a deletion if its number is a multiple of 4."""
    base = entries(_table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string"), schema.int64(F.lit(0)))
    o = _table(spark, sf_dir, "orders")
    journal = entries(o, F.col("o_custkey").cast("string"), schema.int64(F.col("o_orderkey")), F.col("o_orderkey"))
    journal = journal.join(_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key")), "key", "left_semi").withColumn("deleted", F.col("v_int") % 4 == 0)
    return build.replay(base, journal).select(F.col("key").cast("bigint").alias("key"), F.col("v_int").alias("value"))


@query("""SELECT n_regionkey AS dict_id, count(*) AS keys, sum(n_nationkey)::BIGINT AS total FROM nation GROUP BY 1""")
def dict_map_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary for each region, to a map and back."""
    n = _table(spark, sf_dir, "nation")
    built = entries(n, F.col("n_name"), schema.int64(F.col("n_nationkey")), F.col("n_nationkey"), F.col("n_regionkey"))
    again = build.from_map(build.to_map(built, F.col("v_int")), "map", schema.int64, F.col("dict_id"))
    return again.groupBy(F.col("dict_id").cast("int").alias("dict_id")).agg(F.count(F.lit(1)).alias("keys"), F.sum("v_int").alias("total"))


@query("""SELECT c_name AS key FROM customer WHERE starts_with(c_name, 'Customer#00000001')""")
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.prefix(_customers(spark, sf_dir), "Customer#00000001").select("key")


_PREFIXES = ["", "b", "bl", "blue", "c", "small ", "zz", "large r"]


@query(f"""
WITH p(prefix) AS (VALUES {", ".join(f"('{p}')" for p in _PREFIXES)})
SELECT DISTINCT prefix, p_name AS key FROM p JOIN part ON starts_with(p_name, prefix)""")
def prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.prefix_join(_parts(spark, sf_dir), _rows(spark, "prefix", _PREFIXES)).select("prefix", "key")


@query("""SELECT DISTINCT a.n_name AS prefix, b.n_name AS key FROM nation a JOIN nation b ON starts_with(b.n_name, a.n_name)""")
def prefix_join_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key with every key that it starts with."""
    n = _nations(spark, sf_dir)
    return search.prefix_join(n, n.select(F.col("key").alias("prefix"))).select("prefix", "key")


@query("""SELECT DISTINCT p_name AS key FROM part WHERE suffix(p_name, 'ing')""")
def suffix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.suffix_indexed(search.reversed_keys(_parts(spark, sf_dir)), "ing").select("key")


@query("""WITH s(suffix) AS (VALUES ('ing'), ('t'), ('el'), ('zz')) SELECT DISTINCT suffix, p_name AS key FROM s JOIN part ON suffix(p_name, s.suffix)""")
def suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.suffix_join(_parts(spark, sf_dir), _rows(spark, "suffix", ["ing", "t", "el", "zz"])).select("suffix", "key")


@query("""SELECT c_name AS key FROM customer WHERE starts_with(c_name, 'Customer#') AND suffix(c_name, '7')""")
def affix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.affix(_customers(spark, sf_dir), "Customer#", "7").select("key")


@query("""SELECT DISTINCT p_name AS key FROM part WHERE contains(p_name, 'e ')""")
def infix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.infix(_parts(spark, sf_dir), "e ").select("key")


@query("""SELECT c_name AS key, c_acctbal AS value FROM customer WHERE c_name BETWEEN 'Customer#000000010' AND 'Customer#000000099'""")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.between(_customers(spark, sf_dir), "Customer#000000010", "Customer#000000099").select("key", F.col("v_f64").alias("value"))


@query("""SELECT key, levenshtein(key, 'MACHINRY') AS distance FROM (SELECT DISTINCT c_mktsegment AS key FROM customer) WHERE levenshtein(key, 'MACHINRY') <= 2""")
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = build.build(entries(_table(spark, sf_dir, "customer"), F.col("c_mktsegment"), schema.null()))
    return search.fuzzy(keys, "MACHINRY", 2).select("key", "distance")


def _misspelt(spark: SparkSession) -> DataFrame:
    return _rows(spark, "query", ["BULDING", "MACHINRY", "AUTOMOBIL", "FURNITRUE", "HOUSEHOLD", "HOSEHOLDS", "XYZ", "", "small rig", "lagre ring"])


_MISSPELT_SQL = "q(query) AS (VALUES ('BULDING'), ('MACHINRY'), ('AUTOMOBIL'), ('FURNITRUE'), ('HOUSEHOLD'), ('HOSEHOLDS'), ('XYZ'), (''), ('small rig'), ('lagre ring')), k AS (SELECT c_mktsegment AS key FROM customer UNION SELECT p_name FROM part)"


def _fuzzy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = entries(_table(spark, sf_dir, "customer"), F.col("c_mktsegment"), schema.null())
    names = entries(_table(spark, sf_dir, "part"), F.col("p_name"), schema.null())
    return build.build(build.add(segments, names))


@query(f"WITH {_MISSPELT_SQL} SELECT query, key, levenshtein(query, key) AS distance FROM q, k WHERE levenshtein(query, key) <= 1")
def fuzzy_join_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuzzy_join(_fuzzy_keys(spark, sf_dir), _misspelt(spark), 1).select("query", "key", "distance")


@query(f"WITH {_MISSPELT_SQL} SELECT query, key, levenshtein(query, key) AS distance FROM q, k WHERE levenshtein(query, key) <= 2")
def fuzzy_join_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuzzy_join(_fuzzy_keys(spark, sf_dir), _misspelt(spark), 2).select("query", "key", "distance")


@query(f"""WITH {_MISSPELT_SQL}, d AS (SELECT query, key, levenshtein(query, key) AS distance FROM q, k WHERE levenshtein(query, key) <= 2)
SELECT query, key, distance, row_number() OVER (PARTITION BY query ORDER BY distance, key)::INT AS rank FROM d QUALIFY rank <= 1""")
def fuzzy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuzzy_best(_fuzzy_keys(spark, sf_dir), _misspelt(spark), 2, 1).select("query", "key", "distance", "rank")


@query("""
WITH p AS (SELECT p_name AS key, max(p_retailprice) AS value FROM part WHERE starts_with(p_name, 's') GROUP BY 1)
SELECT key, value, row_number() OVER (ORDER BY value DESC, key)::INT AS rank FROM p QUALIFY rank <= 5""")
def autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the limit is the feature."""
    return search.autocomplete(_parts(spark, sf_dir), "s", 5, F.col("v_f64")).select("key", F.col("v_f64").alias("value"), "rank")


@query("""
WITH k AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS key FROM part), q(query) AS (VALUES ('smol'), ('ryng'), ('blew'), ('widjet')),
     w AS (SELECT key AS w FROM k UNION SELECT query FROM q),
     c AS (SELECT w, upper(w[1]) AS head, translate(regexp_replace(upper(w), '[^A-Z]', 'A', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202') AS code FROM w),
     r AS (SELECT w, head, code[1] AS start, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(code, '7', ''), '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g') AS code FROM c),
     s AS (SELECT w, CASE WHEN head BETWEEN 'A' AND 'Z' THEN head || rpad(replace(CASE WHEN start = '7' THEN code ELSE substr(code, 2) END, '0', ''), 3, '0') ELSE w END AS s FROM r)
SELECT query, key FROM q JOIN s AS a ON a.w = query JOIN s AS b USING (s) JOIN k ON k.key = b.w""")
def sounds_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    return search.sounds_like(build.build(entries(words, F.col("w"), schema.null())), _rows(spark, "query", ["smol", "ryng", "blew", "widjet"])).select("query", "key")


@query("""
WITH k AS (SELECT DISTINCT p_name AS key FROM part), q(query) AS (VALUES ('small ring'), ('large bolt'), ('blue')),
     g AS (SELECT DISTINCT key, substr(key, i::INT, 3) AS g FROM k, unnest(range(1, length(key) - 1)) AS u(i)),
     h AS (SELECT DISTINCT query, substr(query, i::INT, 3) AS g FROM q, unnest(range(1, length(query) - 1)) AS u(i)),
     n AS (SELECT query, key, count(*) AS b FROM g JOIN h USING (g) GROUP BY 1, 2),
     gn AS (SELECT key, count(*) AS kn FROM g GROUP BY 1), hn AS (SELECT query, count(*) AS qn FROM h GROUP BY 1)
SELECT query, key, b::DOUBLE / (kn + qn - b) AS similarity FROM n JOIN gn USING (key) JOIN hn USING (query) WHERE b::DOUBLE / (kn + qn - b) >= 0.3""")
def gram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.gram_join(_parts(spark, sf_dir), _rows(spark, "query", ["small ring", "large bolt", "blue"]), 3, 0.3).select("query", "key", "similarity")


def _orders_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each order that has lines: nested objects and an array of its lines.

    Orders compress so well that they look small enough for a broadcast long after they aren't, so the join is merged.
    """
    line = F.struct("l_linenumber", F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), (F.col("l_returnflag") == "R").alias("returned"))
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    doc = F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"), F.struct(F.col("o_custkey").alias("id"), F.lit(None).cast("string").alias("none")).alias("customer"), F.transform("lines", lambda x: x.dropFields("l_linenumber")).alias("lines"))
    return _table(spark, sf_dir, "orders").hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").cast("string").alias("doc_id"), F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


_LINES_SQL = """l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag = 'R') - 1 AS i, l_partkey, l_quantity, l_returnflag FROM lineitem),
o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""


@query(f"""
WITH {_LINES_SQL}
SELECT o_orderkey::VARCHAR AS doc_id, 'order' AS path, 'int' AS kind, o_orderkey::DOUBLE AS number, NULL AS text FROM o
UNION ALL SELECT o_orderkey::VARCHAR, 'status', 'string', NULL, o_orderstatus FROM o
UNION ALL SELECT o_orderkey::VARCHAR, 'customer.id', 'int', o_custkey, NULL FROM o
UNION ALL SELECT o_orderkey::VARCHAR, 'customer.none', 'null', NULL, NULL FROM o
UNION ALL SELECT l_orderkey::VARCHAR, 'lines[' || i || '].part', 'int', l_partkey, NULL FROM l WHERE l_orderkey IN (SELECT o_orderkey FROM o)
UNION ALL SELECT l_orderkey::VARCHAR, 'lines[' || i || '].quantity', 'float64', l_quantity, NULL FROM l WHERE l_orderkey IN (SELECT o_orderkey FROM o)
UNION ALL SELECT l_orderkey::VARCHAR, 'lines[' || i || '].returned', 'bool', NULL, (l_returnflag = 'R')::VARCHAR FROM l WHERE l_orderkey IN (SELECT o_orderkey FROM o)""")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = documents.flatten(_orders_json(spark, sf_dir))
    return flat.select("doc_id", "path", schema.kind_name(F.col("tag")).alias("kind"), schema.number_of().alias("number"), F.coalesce("v_str", F.col("v_bool").cast("string")).alias("text"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", documents.at_path(F.col("props"), "k", "bigint").alias("k"))


@query(f"""
WITH {_LINES_SQL}
SELECT o_orderkey::VARCHAR AS doc_id, p.path, CASE p.path WHEN 'customer.id' THEN true WHEN 'customer.none' THEN true WHEN 'customer' THEN false
  ELSE EXISTS (SELECT 1 FROM l WHERE l_orderkey = o_orderkey AND i = 2) END AS found,
  CASE p.path WHEN 'customer.id' THEN o_custkey::DOUBLE WHEN 'lines[2].part' THEN (SELECT max(l_partkey) FROM l WHERE l_orderkey = o_orderkey AND i = 2)::DOUBLE END AS number
FROM o, (VALUES ('customer.id'), ('customer.none'), ('customer'), ('lines[2].part')) AS p(path)""")
def json_lookup_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = documents.flatten(_orders_json(spark, sf_dir))
    paths = _rows(spark, "path", ["customer.id", "customer.none", "customer", "lines[2].part"])
    return documents.lookup_paths(flat, paths).select("doc_id", "path", "found", schema.number_of().alias("number"))


@query("""
SELECT o_orderkey::VARCHAR AS doc_id, 'object' AS root, 4 AS top, 4 + 3 * count(*) AS leaves FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def json_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents.with_leaf_counts(_orders_json(spark, sf_dir))
    return docs.select("doc_id", documents.root_type(F.col("json")).alias("root"), documents.count_top_level(F.col("json")).alias("top"), "leaves")


@query("""SELECT event_id, je.key, je.value::VARCHAR AS value FROM events, json_each(props) AS je""")
def json_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("json"))
    return documents.members(docs).select(F.col("doc_id").alias("event_id"), "key", "value")


@query("""
SELECT o_orderkey::VARCHAR AS doc_id, count(*) AS lines, sum(l_partkey)::BIGINT AS parts, arg_max(l_partkey, (l_linenumber, l_partkey)) AS last_part
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents flattened, built again, and compared with their source: the lines keep their order beyond ten."""
    again = documents.rebuilt(_orders_json(spark, sf_dir))
    parsed = again.select("doc_id", F.from_json("json", "lines array<struct<part: bigint>>").alias("d"))
    return parsed.select("doc_id", F.size("d.lines").cast("bigint").alias("lines"), F.aggregate("d.lines", F.lit(0).cast("bigint"), lambda a, x: a + x["part"]).alias("parts"), F.element_at("d.lines", -1)["part"].alias("last_part"))


@query("""SELECT event_id::VARCHAR AS doc_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
def json_binary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to the binary format and back."""
    docs = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("doc_id"), F.col("props").alias("json"))
    encoded = trie.encode(documents.to_entries(documents.flatten(docs), docs))
    again = documents.unflatten(documents.from_entries(trie.decode(encoded)))
    return again.select("doc_id", documents.at_path(F.col("json"), "k", "bigint").alias("k"))


@query("""
WITH k AS (SELECT DISTINCT p_name FROM part),
     c AS (SELECT ascii(substr(p_name, i::INT, 1)) AS byte, count(*) AS n FROM k, unnest(range(1, length(p_name) + 1)) AS u(i) GROUP BY 1)
SELECT byte, n, (row_number() OVER (ORDER BY byte) + 5)::INT AS code FROM c""")
def symbol_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.symbol_stats(_parts(spark, sf_dir))


@query("""
WITH k AS (SELECT DISTINCT p_name FROM part),
     c AS (SELECT substr(p_name, i::INT, 1) AS b, count(*) AS n FROM k, unnest(range(1, length(p_name) + 1)) AS u(i) GROUP BY 1), t AS (SELECT sum(n) AS a FROM c)
SELECT count(*) AS symbols, round(sum(-(n / a) * log2(n / a)), 9) AS entropy_bits, length(bin(count(*) + 5)) AS fixed_bits FROM c, t""")
def symbol_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.entropy(_parts(spark, sf_dir)).select("symbols", F.round("entropy_bits", 9).alias("entropy_bits"), "fixed_bits")


@query("""
WITH k AS (SELECT DISTINCT c_name AS k FROM customer)
SELECT substr(k, 1, i::INT) AS prefix, count(*) AS keys, bool_or(i = length(k)) AS terminal FROM k, unnest(range(1, length(k) + 1)) AS u(i) GROUP BY 1""")
def prefix_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.prefix_nodes(_customers(spark, sf_dir)).select(F.col("prefix").cast("string").alias("prefix"), "keys", "terminal")


@query("""
WITH k AS (SELECT DISTINCT n_name AS k FROM nation),
     p AS (SELECT DISTINCT substr(k, 1, i::INT) AS prefix FROM k, unnest(range(0, length(k) + 1)) AS u(i)),
     c AS (SELECT substr(prefix, 1, length(prefix) - 1) AS prefix, count(*) AS children FROM p WHERE prefix <> '' GROUP BY 1)
SELECT prefix, coalesce(children, 0) AS children, prefix IN (SELECT k FROM k) AS terminal FROM p LEFT JOIN c USING (prefix)""")
def branch_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.branch_fanout(_nations(spark, sf_dir)).select(F.col("prefix").cast("string").alias("prefix"), "children", "terminal")


@query("""
WITH g AS (SELECT p_brand, min(p_name) AS lo, max(p_name) AS hi, count(DISTINCT p_name) AS keys FROM part GROUP BY 1)
SELECT p_brand, keys, substr(lo, 1, coalesce((SELECT max(i) FROM unnest(range(1, least(length(lo), length(hi)) + 1)) AS u(i) WHERE substr(lo, 1, i::INT) = substr(hi, 1, i::INT)), 0)::INT) AS prefix FROM g""")
def group_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyze.group_prefixes(_table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("key")), "p_brand")
    return found.withColumn("prefix", F.col("prefix").cast("string"))


@query("""SELECT substr(p_name, 3, 1) AS next, count(*) AS keys FROM (SELECT DISTINCT p_name FROM part) WHERE length(p_name) > 2 GROUP BY 1""")
def child_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.child_groups(_parts(spark, sf_dir), 2).select(F.col("next").cast("string").alias("next"), "keys")


@query("""SELECT right(p_name, 3) AS suffix, count(*) AS keys FROM (SELECT DISTINCT p_name FROM part) WHERE length(p_name) >= 3 GROUP BY 1 HAVING count(*) >= 2""")
def suffix_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.suffix_stats(_parts(spark, sf_dir))


@query("""
WITH k AS (SELECT DISTINCT p_name AS k FROM part),
     s AS (SELECT substr(k, 1, i::INT) AS p, list(substr(k, i::INT + 1) ORDER BY substr(k, i::INT + 1)) AS r FROM k, unnest(range(0, length(k) + 1)) AS u(i) GROUP BY 1)
SELECT count(*) AS nodes, count(DISTINCT r) AS classes FROM s""")
def mergeable_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.mergeable_subtrees(_parts(spark, sf_dir))


@query("""
WITH k AS (SELECT DISTINCT c_name AS k FROM customer), b AS (SELECT k, coalesce(lag(k) OVER (ORDER BY k), '') AS p FROM k)
SELECT k AS key, coalesce((SELECT max(i) FROM unnest(range(1, least(length(k), length(p)) + 1)) AS u(i) WHERE substr(k, 1, i::INT) = substr(p, 1, i::INT)), 0)::INT AS shared FROM b""")
def shared_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.shared_prefixes(_customers(spark, sf_dir))


@query("""SELECT count(value) AS values, count(DISTINCT value) AS distinct_values FROM (SELECT arg_max(value, event_id) AS value FROM events GROUP BY event_type, user_id)""")
def value_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.value_stats(_events(spark, sf_dir)).select("values", "distinct_values")


@query("""
WITH n AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey ELSE -l_orderkey END AS x FROM lineitem),
     z AS (SELECT *, CASE WHEN x >= 0 THEN 2 * x ELSE -2 * x - 1 END AS zigzag FROM n)
SELECT l_orderkey, l_linenumber, zigzag, (ceil(length(bin(zigzag)) / 7.0) * 8)::INT AS bits, x AS back FROM z""")
def zigzag_varint(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey")).otherwise(-F.col("l_orderkey"))
    z = bits.zigzag(x)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", z.alias("zigzag"), bits.varint_bits(z).alias("bits"), bits.read_signed_varint(bits.signed_varint(x)).alias("back"))


@query("""
WITH b AS (SELECT o_orderkey AS x FROM orders)
SELECT x, upper(CASE WHEN x < 128 THEN printf('%02X', x) WHEN x < 16384 THEN printf('%02X%02X', x % 128 + 128, x // 128)
  WHEN x < 2097152 THEN printf('%02X%02X%02X', x % 128 + 128, x // 128 % 128 + 128, x // 16384)
  ELSE printf('%02X%02X%02X%02X', x % 128 + 128, x // 128 % 128 + 128, x // 16384 % 128 + 128, x // 2097152) END) AS bytes, x AS back FROM b""")
def varint_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = bits.varint(F.col("o_orderkey"))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("x"), F.hex(code).alias("bytes"), bits.read_varint(code).cast("bigint").alias("back"))


@query("""SELECT o_orderkey, (o_orderkey // 8) % 32 AS field, CASE WHEN (o_orderkey // 8) % 32 >= 16 THEN (o_orderkey // 8) % 32 - 32 ELSE (o_orderkey // 8) % 32 END AS signed, o_orderkey % 65536 AS u16 FROM orders""")
def bit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five bits of the low byte pair, read back from bytes."""
    data = bits.write_uint(F.col("o_orderkey"), 4)
    text = bits.bit_string(data)
    return _table(spark, sf_dir, "orders").select("o_orderkey", bits.read_bits(text, F.lit(24), 5).cast("bigint").alias("field"), bits.read_bits_signed(text, F.lit(24), 5).alias("signed"), bits.read_uint(data, F.lit(2), 2).cast("bigint").alias("u16"))


@query("""SELECT doc_id, length(text) AS points, strlen(text)::INT AS bytes FROM documents""")
def utf8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = bits.code_points(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(points).cast("bigint").alias("points"), F.aggregate(points, F.lit(0), lambda a, c: a + bits.utf8_length(c)).alias("bytes"))


_CRC = "[" + ", ".join(str(reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(8), n)) for n in range(256)) + "]"


@query(f"""
WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT c_name FROM customer), t AS (SELECT {_CRC}::BIGINT[] AS t), h AS (SELECT name, hex(encode(name)) AS h FROM n),
     b AS (SELECT name, list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i::INT, 2))::BIGINT)) AS b FROM h)
SELECT name, lower(printf('%08x', xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::BIGINT))) AS crc32 FROM b, t""")
def crc32_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).union(_table(spark, sf_dir, "customer").select("c_name")).distinct()
    return names.select("name", bits.checksum(F.col("name").cast("binary")).alias("crc32"))


@query()
def crc32_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", bits.checksum(F.col("text").cast("binary")).alias("crc32"))


@query("""SELECT doc_id, sha256(text) AS sha256 FROM documents""")
def sha256_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", bits.checksum(F.col("text").cast("binary"), "sha256").alias("sha256"))


@query("""SELECT c_name AS key, c_acctbal AS value FROM customer""")
def trie_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary for each nation's customers, to the binary format and back."""
    c = _table(spark, sf_dir, "customer")
    built = build.build(entries(c, F.col("c_name"), schema.float64(F.col("c_acctbal")), F.col("c_custkey"), F.col("c_nationkey")))
    return trie.decode(trie.encode(built)).select("key", F.col("v_f64").alias("value"))


@query("""SELECT c_nationkey::VARCHAR AS dict_id, count(*) AS num_keys, true AS has_values, true AS magic, true AS valid FROM customer GROUP BY 1""")
def trie_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    built = build.build(entries(c, F.col("c_name"), schema.float64(F.col("c_acctbal")), F.col("c_custkey"), F.col("c_nationkey")))
    return trie.headers(trie.encode(built)).select("dict_id", "num_keys", "has_values", "magic", "valid")


@query()
def trie_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys only, as the published sizes: bytes and bits a key of a dictionary of all part names and customers' names."""
    keys = build.build(build.add(entries(_table(spark, sf_dir, "part"), F.col("p_name"), schema.null(), dict_id=F.lit("part")), entries(_table(spark, sf_dir, "customer"), F.col("c_name"), schema.null(), dict_id=F.lit("customer"))))
    return analyze.sizes(keys, trie.encode(keys))


@query("""SELECT p || s || e AS key FROM (VALUES ('re'), ('un'), ('')) AS a(p), (VALUES ('load'), ('do'), ('pack')) AS b(s), (VALUES ('ing'), ('ed'), ('')) AS c(e)""")
def generated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.words(spark, ["load", "do", "pack"], ["re", "un", ""], ["ing", "ed", ""])


@query("""SELECT n_name, 'uint' AS kind, n_nationkey::VARCHAR AS text FROM nation""")
def value_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_side(_nations(spark, sf_dir)).select(F.col("key").alias("n_name"), schema.kind_name(F.col("tag")).alias("kind"), schema.text_of().alias("text"))


@query("""
WITH k AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS key FROM documents), b AS (SELECT key, hex(encode(key)) AS k, hex(encode(coalesce(lag(key) OVER (ORDER BY encode(key)), ''))) AS p FROM k)
SELECT key, len(list_filter(range(1, (least(length(k), length(p)) // 2) + 1), lambda i: substr(k, 1, (2 * i)::INT) = substr(p, 1, (2 * i)::INT)))::INT AS shared FROM b""")
def shared_prefix_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in four languages, whose characters have one to three bytes."""
    return analyze.shared_prefixes(_table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("key")))


@query("""
WITH probes AS (SELECT o_orderkey, c_name AS key, (c_nationkey + o_orderkey % 2)::VARCHAR AS dict_id FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, key, p.dict_id, c_name IS NOT NULL AS found, c_acctbal AS value FROM probes AS p LEFT JOIN customer ON key = c_name AND p.dict_id = c_nationkey::VARCHAR""")
def dict_lookup_by_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary for each nation's customers; every order's customer is looked up in one, every other time in the wrong one."""
    c = _table(spark, sf_dir, "customer")
    built = build.build(entries(c, F.col("c_name"), schema.float64(F.col("c_acctbal")), F.col("c_custkey"), F.col("c_nationkey")))
    probes = _table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_name").alias("key"), (F.col("c_nationkey") + F.col("o_orderkey") % 2).cast("string").alias("dict_id"))
    return lookup.lookup(built, probes).select("o_orderkey", "key", "dict_id", "found", F.col("v_f64").alias("value"))


@query("""
WITH b AS (SELECT o_orderkey, right(lpad(bin(o_orderkey), 64, '0'), 20) AS written FROM orders)
SELECT o_orderkey, written, substr(written, 4, 7) AS copied, written || substr(written, 4, 7) AS appended, 20 - o_orderkey % 20 AS remaining, ((o_orderkey % 20 + 7) // 8) * 8 AS aligned, o_orderkey % 20 % 8 = 0 AS is_aligned,
       substr(lpad(hex(o_orderkey), 8, '0'), 3, 4) AS bytes, rpad(written, 24, '0') AS filled FROM b""")
def bit_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty bits written, copied and appended, a cursor within them, and bytes read from an offset."""
    written, position = bits.write_bits(F.col("o_orderkey"), 20), F.col("o_orderkey") % 20
    copied = bits.copy_bits(written, F.lit(3), F.lit(7))
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", written.alias("written"), copied.alias("copied"), bits.append(written, copied).alias("appended"), bits.remaining(written, position).cast("bigint").alias("remaining"), bits.aligned(position).cast("bigint").alias("aligned"), bits.is_aligned(position).alias("is_aligned"),
        F.hex(bits.read_bytes(bits.write_uint(F.col("o_orderkey"), 4), F.lit(1), F.lit(2))).alias("bytes"), bits.bit_string(bits.bytes_of(written)).alias("filled"),
    )


@query("""SELECT o_orderkey::VARCHAR AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'syntax' ELSE 'depth' END AS fault FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 41 > 32""")
def json_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents nested up to 40 deep, of which every third isn't closed."""
    depth = (F.col("o_orderkey") % 41).cast("int")
    closed = F.when(F.col("o_orderkey") % 3 != 0, F.repeat(F.lit("]"), depth)).otherwise("")
    texts = F.when((depth == 0) & (F.col("o_orderkey") % 3 != 0), "[]").otherwise(F.concat(F.repeat(F.lit("["), F.when(F.col("o_orderkey") % 3 == 0, F.least(depth, F.lit(30))).otherwise(depth)), F.lit("1"), closed))
    return documents.faults(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), texts.alias("json")))


@query(f"""
WITH r(code, text) AS (VALUES {", ".join(f"({k}, '{v}')" for k, v in schema.RESULTS.items())}), c AS (SELECT DISTINCT (-(o_orderkey % 25))::INT AS code FROM orders)
SELECT code, coalesce(text, 'unknown error') AS text FROM c LEFT JOIN r USING (code)""")
def result_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _table(spark, sf_dir, "orders").select((-(F.col("o_orderkey") % 25)).cast("int").alias("code")).distinct()
    return codes.select("code", schema.result_text(F.col("code")).alias("text"))


@query("""
WITH k AS (SELECT DISTINCT p_name AS key FROM part), q AS (SELECT DISTINCT regexp_replace(p_name, 'l', '') AS query FROM part)
SELECT query, key, levenshtein(query, key)::INT AS distance FROM q, k WHERE abs(length(query) - length(key)) <= 1 AND levenshtein(query, key) <= 1""")
def fuzzy_join_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without their first l, by variants that are written once."""
    keys = _parts(spark, sf_dir)
    queries = _table(spark, sf_dir, "part").select(F.regexp_replace("p_name", "^([^l]*)l", "$1").alias("query"))
    return search.fuzzy_join(keys, queries, 1, cut(search.fuzzy_index(keys, 1), "variants")).select("query", "key", "distance")


@query(f"""SELECT * FROM (VALUES {", ".join(f"('{k}', {len(v[0])}, {v[1]})" for k, v in fixtures.GOLDEN.items() if v[0])}) AS t(dict_id, keys, bytes)""")
def trie_published_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden dictionaries in the binary format, against the sizes that are published for them."""
    built = build.build(fixtures.golden(spark))
    return analyze.sizes(built, trie.encode(built)).select("dict_id", F.col("keys").cast("int").alias("keys"), F.col("encoded_bytes").cast("int").alias("bytes"))


@query(f"""SELECT * FROM (VALUES {", ".join(f"('{k}', {keys}, {size})" for k, (_, keys, size) in fixtures.SMALL_DOCUMENTS.items())}) AS t(dict_id, keys, bytes)""")
def json_published_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small documents in the binary form, against the sizes that are published for them."""
    docs = spark.createDataFrame([(k, v[0]) for k, v in fixtures.SMALL_DOCUMENTS.items()], "doc_id string, json string")
    built = documents.to_entries(documents.flatten(docs), docs)
    return analyze.sizes(built, trie.encode(built)).select("dict_id", F.col("keys").cast("int").alias("keys"), F.col("encoded_bytes").cast("int").alias("bytes"))


@query("""SELECT 'catalog' AS doc_id, 200 AS products""")
def catalog_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of 200 products that the JSON benchmark encodes."""
    return analyze.catalog(spark, 200).select("doc_id", F.size(F.from_json("json", "products array<struct<id: bigint>>")["products"]).alias("products"))
