"""The entry schema: a dictionary is a DataFrame with one row a key and a tagged value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds of values; the index of a kind is its tag.
KINDS = ("null", "bool", "int", "uint", "float32", "float64", "string", "blob", "array", "dict")
#: Payload column and type of each kind. Arrays and nested dictionaries are JSON text.
PAYLOAD = {
    "bool": ("v_bool", "boolean"),
    "int": ("v_int", "bigint"),
    "uint": ("v_uint", "decimal(20,0)"),
    "float32": ("v_f32", "float"),
    "float64": ("v_f64", "double"),
    "string": ("v_str", "string"),
    "blob": ("v_blob", "binary"),
    "array": ("v_str", "string"),
    "dict": ("v_str", "string"),
}
COLUMNS = tuple(dict.fromkeys(c for c, _ in PAYLOAD.values()))
TYPES = {c: t for c, t in PAYLOAD.values()}
VALUE = ("tag", *COLUMNS)
ENTRY = "dict_id string, key string, seq bigint, tag tinyint, " + ", ".join(f"{c} {t}" for c, t in TYPES.items())
RAW_ENTRY = ENTRY.replace("key string", "key binary")


def value(kind: str, payload: Column | None = None) -> Column:
    """A tagged value. Where the payload is null, the value is the null value, which is present."""
    tag = KINDS.index(kind)
    if (payload is None) != (kind == "null"):
        raise ValueError("every kind but null has a payload")
    target = PAYLOAD.get(kind, (None,))[0]
    fields = [(payload if c == target else F.lit(None)).cast(t).alias(c) for c, t in TYPES.items()]
    known = F.lit(tag) if payload is None else F.when(payload.isNull(), F.lit(0)).otherwise(F.lit(tag))
    return F.struct(known.cast("tinyint").alias("tag"), *fields)


def null() -> Column:
    return value("null")


def boolean(c: Column) -> Column:
    return value("bool", c)


def int64(c: Column) -> Column:
    return value("int", c)


def uint64(c: Column) -> Column:
    """Unsigned 64 bits, as a decimal; a negative payload or one beyond 2^64 - 1 raises an error."""
    d = c.cast("decimal(20,0)")
    good = d.isNull() | d.between(F.lit("0").cast("decimal(20,0)"), F.lit("18446744073709551615").cast("decimal(20,0)"))
    return value("uint", F.when(good, d).otherwise(F.raise_error(F.lit("not an unsigned 64-bit value")).cast("decimal(20,0)")))


def float32(c: Column) -> Column:
    return value("float32", c)


def float64(c: Column) -> Column:
    return value("float64", c)


def string(c: Column) -> Column:
    return value("string", c)


def blob(c: Column) -> Column:
    return value("blob", c)


def array(c: Column) -> Column:
    """An array value, kept as JSON; the binary format refuses it."""
    return value("array", F.to_json(c))


def nested(c: Column) -> Column:
    """A nested dictionary (a map or struct), kept as JSON; the binary format refuses it."""
    return value("dict", F.to_json(c, {"ignoreNullFields": "false"}))


def kind_name(tag: Column) -> Column:
    """The name of a tag; null for an unknown one."""
    return F.when(tag.between(0, len(KINDS) - 1), F.element_at(F.array(*[F.lit(k) for k in KINDS]), tag.cast("int") + 1))


def text_of(prefix: str = "") -> Column:
    """The value of an entry as text; blobs in hexadecimal, null as 'null'."""
    shown = [F.hex(f"{prefix}{c}") if c == "v_blob" else F.col(f"{prefix}{c}").cast("string") for c in COLUMNS]
    return F.coalesce(*shown, F.lit("null"))


def number_of(prefix: str = "") -> Column:
    """The value of an entry as a double, whichever numeric kind it has; else null. Kinds compare by number, not by tag."""
    return F.coalesce(*[F.col(f"{prefix}{c}").cast("double") for c in ("v_int", "v_uint", "v_f64", "v_f32")])


#: What the result codes of the C interface mean: 0 is success, others are negative.
RESULTS = {
    0: "OK", -1: "read past end of stream", -2: "memory allocation failed", -3: "invalid parameter", -4: "seek beyond bounds", -5: "not byte-aligned",
    -6: "varint overflow", -7: "invalid UTF-8", -10: "bad magic bytes", -11: "unsupported version", -12: "data corrupt", -13: "key not found",
    -14: "data truncated", -20: "JSON syntax error", -21: "JSON nesting too deep", -22: "JSON type mismatch",
}


def result_text(code: Column) -> Column:
    """What a result code means; null for null."""
    known = F.create_map(*[F.lit(x) for pair in RESULTS.items() for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(known, code.cast("int")), F.lit("unknown error")))


def json_of(prefix: str = "", blobs: bool = False) -> Column:
    """The value as JSON text; blobs are null, or base64 if ``blobs``."""
    v = lambda c: F.col(prefix + c)
    quoted = lambda c: F.get(F.split(F.to_json(F.array(c)), "\u0000", -1), F.lit(0))
    inner = lambda c: F.substring(quoted(c), 2, 1 << 30).substr(F.lit(1), F.length(quoted(c)) - 2)
    blob_text = inner(F.base64(v("v_blob"))) if blobs else F.lit("null")
    return (
        F.when(v("tag") == 6, inner(v("v_str")))
        .when(v("tag") == 7, blob_text)
        .when(v("tag").isin(8, 9), v("v_str"))
        .when(v("tag") == 5, inner(v("v_f64")))
        .when(v("tag") == 4, inner(v("v_f32")))
        .otherwise(text_of(prefix))
    )


def entries(df: DataFrame, key: Column, val: Column, seq: Column | None = None, dict_id: Column | None = None) -> DataFrame:
    """Rows of ``df`` as entries. ``seq`` is the order of insertion, 0 without one."""
    named = F.lit("") if dict_id is None else dict_id
    keyed = df.select(named.cast("string").alias("dict_id"), key.alias("key"), (F.lit(0) if seq is None else seq).cast("bigint").alias("seq"), val.alias("__v"))
    return keyed.select("dict_id", "key", "seq", "__v.*")


def empty(spark: SparkSession, raw: bool = False) -> DataFrame:
    """No entries; the key is binary if ``raw``."""
    return spark.createDataFrame([], RAW_ENTRY if raw else ENTRY)
