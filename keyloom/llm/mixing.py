"""Mix sources to target weights by repeating or thinning their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.plans.names import fresh, others
from keyloom.plans.sizing import small_side

#: Exponent of the token counts that gives the default target weights: below 1, small sources gain.
ALPHA = 0.7
SEED = "mix-1"
_TOKEN = "[^ \\t\\n\\r\\f]+"


def unit_draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on ``key`` and ``seed`` alone. A null key counts as ''."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, epochs: float = 1.0) -> DataFrame:
    """(source, n_docs, n_tokens, rate): how often a document of each source is to be emitted on average.

    The mixture has ``epochs`` times the tokens of ``docs``; source s gets a share of them in proportion to
    ``weights[s]`` (0 where it is missing), or to its tokens to the power ``alpha`` without weights. The rate is that
    share over the source's own tokens, to six decimals. A source without tokens has rate 1 and no weight. Null is a
    source of its own.
    """
    per = docs.groupBy(F.col("source").cast("string").alias("source")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum(F.regexp_count(F.col("text"), F.lit(_TOKEN)).cast("long")), F.lit(0)).alias("n_tokens"),
    )
    if weights is None:
        weight = F.when(F.col("n_tokens") > 0, F.pow(F.col("n_tokens").cast("double"), F.lit(alpha))).otherwise(0.0)
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.lit(None)
        weight = F.coalesce(given[F.col("source")] if weights else F.lit(None).cast("double"), F.lit(0.0))
    whole = per.select("*", weight.alias("w")).crossJoin(per.select(weight.alias("w"), "n_tokens").agg(F.sum("w").alias("w_all"), F.sum("n_tokens").alias("t_all")))
    rate = F.when(F.col("n_tokens") == 0, F.lit(1.0)).otherwise(F.coalesce(F.round(F.lit(epochs) * F.col("t_all") * F.col("w") / F.nullif(F.col("w_all"), F.lit(0.0)) / F.col("n_tokens"), 6), F.lit(0.0)))
    return whole.select("source", "n_docs", "n_tokens", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, epochs: float = 1.0, seed: str = SEED, copy_column: str | None = "copy") -> DataFrame:
    """Each document of ``docs`` floor(rate) times, and once more with probability rate - floor(rate).

    Two scans: one sums tokens by source (partial aggregation, a row per source is shuffled), one emits. The rates are
    broadcast if there are few sources, else joined by a shuffle. The extra copy depends on ``doc_id`` and ``seed``
    alone, so a retried task emits the same rows.

    ``copy_column`` numbers the copies from 0 and replaces a column of that name, in upper or lower case; None leaves it
    out. Null or empty texts have 0 tokens, very long ones are counted whole; ties can't occur; a null ``doc_id`` draws as ''; repeated rows draw alike; an empty table gives an empty one;
    other columns are passed on.
    """
    src, rate, n, number = fresh(docs, "__src", "__rate", "__n", "__copy")
    rates = small_side(source_rates(docs, weights, alpha, epochs).select(F.col("source").alias(src), F.col("rate").alias(rate)))
    joined = docs.join(rates, docs["source"].cast("string").eqNullSafe(rates[src]), "inner")
    whole = F.floor(rate)
    times = (whole + (unit_draw(F.col("doc_id"), seed) < F.col(rate) - whole).cast("long")).cast("int")
    copies = joined.withColumn(n, times).where(F.col(n) > 0).withColumn(number, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    if copy_column is None:
        return copies.select(*docs.columns)
    return copies.select(*others(docs, copy_column), F.col(number).alias(copy_column))


ORACLE_SQL = f"""
WITH per AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+'))) AS t FROM documents GROUP BY source),
     weighed AS (SELECT source, t, CASE WHEN t > 0 THEN pow(t::DOUBLE, {ALPHA}) ELSE 0 END AS w FROM per),
     rates AS (SELECT source, CASE WHEN t = 0 THEN 1.0 ELSE round((SELECT sum(t)::DOUBLE FROM weighed) * w / (SELECT sum(w) FROM weighed) / t, 6) END AS rate FROM weighed),
     drawn AS (SELECT d.*, (floor(rate) + CASE WHEN ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::INT AS n
               FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n))::INT AS copy FROM drawn WHERE n > 0
"""
