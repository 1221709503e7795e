"""The structure and size of sets of keys: alphabets, prefixes, branches, shared endings, and the size of the binary format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.bits import bits_needed, varint_bits, zigzag
from keyloom.plans.lineage import cut

CONTROL_CODES = 6


def _bytes(key: Column) -> Column:
    """The bytes of a key as numbers, with their places from 1."""
    raw, n = key.cast("binary"), F.octet_length(key)
    one = lambda i: F.struct(i.alias("place"), F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int").alias("byte"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), one))


def symbol_stats(keys: DataFrame) -> DataFrame:
    """(byte, n, code): how often each byte occurs in the distinct keys (key), and its code in the alphabet."""
    counted = keys.select("key").distinct().select(F.explode(_bytes(F.col("key"))).alias("b")).groupBy("b.byte").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("code", (F.row_number().over(Window.orderBy("byte")) + (CONTROL_CODES - 1)).cast("int"))


def entropy(keys: DataFrame) -> DataFrame:
    """One row: symbols, bits a symbol at a fixed width, and by Shannon's entropy."""
    stats = symbol_stats(keys).select("n", F.sum("n").over(Window.partitionBy()).alias("all"))
    share = F.col("n") / F.col("all")
    return stats.agg(F.count(F.lit(1)).alias("symbols"), F.sum(-share * F.log2(share)).alias("entropy_bits")).withColumn("fixed_bits", bits_needed(F.col("symbols")))


def prefix_nodes(keys: DataFrame) -> DataFrame:
    """(prefix, keys, terminal): every prefix of the distinct keys but the empty one, by bytes.

    The nodes of an uncompressed trie: how many keys are below each, and whether it is a key.
    """
    distinct = keys.select(F.col("key").cast("binary").alias("key")).distinct()
    n = F.octet_length("key")
    starts = distinct.select("key", F.explode(F.when(n > 0, F.sequence(F.lit(1), n))).alias("depth")).select(F.substring(F.col("key"), F.lit(1), F.col("depth")).alias("prefix"), (F.col("depth") == F.octet_length("key")).alias("terminal"))
    return starts.groupBy("prefix").agg(F.count(F.lit(1)).alias("keys"), F.bool_or("terminal").alias("terminal"))


def branch_fanout(keys: DataFrame) -> DataFrame:
    """(prefix, children, terminal): the children of every node, the root (an empty prefix) included."""
    nodes = prefix_nodes(keys)
    parent = nodes.select(F.substring(F.col("prefix"), F.lit(1), F.octet_length("prefix") - 1).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("children"))
    own = nodes.select("prefix", "terminal").unionByName(keys.groupBy().agg(F.coalesce(F.bool_or(F.octet_length("key") == 0), F.lit(False)).alias("terminal")).select(F.lit(b"").alias("prefix"), "terminal"))
    return own.join(parent, "prefix", "left").select("prefix", F.coalesce("children", F.lit(0)).cast("bigint").alias("children"), "terminal")


def shared_bytes(a: Column, b: Column) -> Column:
    """How many bytes two keys have in common at their starts; null if one is null."""
    a, b = a.cast("binary"), b.cast("binary")
    n = F.least(F.octet_length(a), F.octet_length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    same = F.size(F.filter(places, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    return F.when(a.isNotNull() & b.isNotNull(), same)


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common start of two keys, by bytes, as binary: it may end within a character."""
    return F.substring(a.cast("binary"), F.lit(1), shared_bytes(a, b))


def group_prefixes(keys: DataFrame, by: str) -> DataFrame:
    """The longest prefix, in bytes, that the keys of each group share: that of its least and greatest key."""
    ends = keys.groupBy(by).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count_distinct("key").alias("keys"))
    return ends.select(by, "keys", common_prefix(F.col("lo"), F.col("hi")).alias("prefix"))


def shared_prefixes(keys: DataFrame) -> DataFrame:
    """(key, shared): of each distinct key, how many bytes it shares with the one before it in order.

    Keys are sorted in ranges of equal size, whatever they begin with, and compared within them; the first key of a
    range is compared with the last one of the ranges before, of which there is a row each. A null key is none.
    """
    ranges = cut(keys.select("key").where("key is not null").distinct().repartitionByRange("key").withColumn("__range", F.spark_partition_id()), "ranges")
    ends = ranges.groupBy("__range").agg(F.max("key").alias("__end"))
    ends = ends.select((F.lead("__range").over(Window.orderBy("__range"))).alias("__range"), "__end").where("__range is not null")
    before = F.coalesce(F.lag("key").over(Window.partitionBy("__range").orderBy("key")), F.col("__end"), F.lit(""))
    return ranges.join(F.broadcast(ends), "__range", "left").select("key", shared_bytes(F.col("key"), before).alias("shared"))


def child_groups(keys: DataFrame, depth: int) -> DataFrame:
    """(next, keys): the distinct keys longer than ``depth`` by their next byte."""
    rest = keys.select("key").distinct().where(F.octet_length("key") > depth)
    return rest.groupBy(F.substring(F.col("key").cast("binary"), depth + 1, 1).alias("next")).agg(F.count(F.lit(1)).alias("keys"))


def suffix_stats(keys: DataFrame, least: int = 2, length: int = 3) -> DataFrame:
    """(suffix, keys): endings of ``length`` characters that at least ``least`` distinct keys have."""
    long = keys.select("key").distinct().where(F.length("key") >= length)
    return long.groupBy(F.right("key", F.lit(length)).alias("suffix")).agg(F.count(F.lit(1)).alias("keys")).where(F.col("keys") >= least)


def mergeable_subtrees(keys: DataFrame) -> DataFrame:
    """One row: nodes of the trie, and classes of nodes with the same set of continuations (those of a word graph)."""
    distinct = keys.select(F.col("key").cast("binary").alias("key")).distinct()
    n = F.octet_length("key")
    split = distinct.select("key", F.explode(F.sequence(F.lit(0), n)).alias("depth")).select(F.substring(F.col("key"), F.lit(1), F.col("depth")).alias("prefix"), F.substring(F.col("key"), F.col("depth") + 1, n).alias("rest"))
    classes = split.groupBy("prefix").agg(F.bit_xor(F.xxhash64("rest")).alias("x"), F.sum(F.xxhash64(F.lit(1), "rest").cast("decimal(38,0)")).alias("s"))
    return classes.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("x", "s").alias("classes"))


def value_stats(entries: DataFrame) -> DataFrame:
    """(dict_id, values, distinct_values): values that aren't null, and how many of them differ."""
    shown = F.when(F.col("tag") != 0, F.struct("tag", "v_bool", "v_int", "v_uint", "v_f32", "v_f64", "v_str", "v_blob"))
    return entries.groupBy("dict_id").agg(F.count(shown).alias("values"), F.count_distinct(shown).alias("distinct_values"))


def value_bits(position: Column | None = None) -> Column:
    """The size of an entry's value in the store, without the padding before strings and blobs."""
    zz = zigzag(F.col("v_int"))
    int_bits = F.when(zz < 0, 80).otherwise(varint_bits(zz))
    uint_bits = F.when(F.col("v_uint") > F.lit("9223372036854775807").cast("decimal(20,0)"), 80).otherwise(varint_bits(F.col("v_uint").cast("bigint")))
    size = F.coalesce(F.octet_length("v_str"), F.octet_length("v_blob"))
    tag = F.col("tag")
    return F.lit(4) + F.when(tag == 1, 1).when(tag == 2, int_bits).when(tag == 3, uint_bits).when(tag == 4, 32).when(tag == 5, 64).when(tag.isin(6, 7), varint_bits(size) + 8 * size).otherwise(0)


def sizes(entries: DataFrame, encoded: DataFrame) -> DataFrame:
    """(dict_id, keys, key_bytes, encoded_bytes, ratio, bits_per_key) of built entries and their encodings (dict_id, content)."""
    raw = entries.groupBy("dict_id").agg(F.count(F.lit(1)).alias("keys"), F.sum(F.octet_length("key")).alias("key_bytes"))
    size = encoded.select("dict_id", F.octet_length("content").cast("bigint").alias("encoded_bytes"))
    return raw.join(size, "dict_id").select("dict_id", "keys", "key_bytes", "encoded_bytes", (F.col("key_bytes") / F.col("encoded_bytes")).alias("ratio"), (F.col("encoded_bytes") * 8 / F.col("keys")).alias("bits_per_key"))


def words(spark, stems: list[str], prefixes: list[str], suffixes: list[str]) -> DataFrame:
    """(key): every prefix, stem and suffix joined, once each."""
    table = lambda name, xs: spark.createDataFrame([(x,) for x in xs], f"{name} string")
    joined = table("p", prefixes).crossJoin(table("s", stems)).crossJoin(table("e", suffixes))
    return joined.select(F.concat("p", "s", "e").alias("key")).distinct()


def catalog(spark, products: int, seed: int = 42) -> DataFrame:
    """(doc_id, json): one document of a catalogue of products, made from hashes of their numbers."""
    pick = lambda what, n: F.pmod(F.xxhash64(F.lit(what), F.col("id"), F.lit(seed)), F.lit(n)).cast("int")
    price = (pick("price", 99_900) + 100) / 100
    tags = F.transform(F.sequence(F.lit(0), pick("tags", 4)), lambda i: F.concat(F.lit("tag-"), i.cast("string")))
    product = F.struct(
        F.col("id"), F.format_string("SKU-%05d", "id").alias("sku"), F.concat(F.lit("product "), F.col("id").cast("string")).alias("name"), price.alias("price"), (pick("stock", 2) == 1).alias("in_stock"), tags.alias("tags"),
        F.struct(*[(pick(side, 1000) / 10).alias(side) for side in ("width", "height", "depth")]).alias("dimensions"),
    )
    rows = spark.range(products).select("id", product.alias("p"))
    return rows.agg(F.sort_array(F.collect_list("p")).alias("products")).select(F.lit("catalog").alias("doc_id"), F.to_json(F.struct(F.lit("1.0").alias("catalog_version"), "products")).alias("json"))
