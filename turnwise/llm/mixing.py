"""Mixing sources to target weights by Poisson replication and a global shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources with their rates up to this many are broadcast (under 10 MB); more of them join by shuffle.
MAX_BROADCAST_SOURCES = 20_000
#: A rate above this is drawn as the sum of several equal parts, so that exp(-rate) stays a normal number.
MAX_RATE = 200.0


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 from 52 bits of the MD5 of the parts, which nulls enter as the word null."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, size: float = 1.0) -> DataFrame:
    """_source, rate: how often, on average, a document of each source should stand in the mixture.

    weights: target share of each source; a source that isn't named gets none. Without weights a source's share goes with its
    rows to the power `temperature`. size: rows of the mixture over rows of docs."""
    counts = docs.groupBy(F.col("source").alias("_source")).agg(F.count("*").cast("double").alias("_n"))
    if weights is None:
        share = F.pow(F.col("_n"), F.lit(float(temperature)))
    else:
        share = F.coalesce(*(F.when(F.col("_source") == k, F.lit(float(v))) for k, v in weights.items()), F.lit(0.0))
    counts = counts.withColumn("_share", share)
    rows, shares = counts.agg(F.sum("_n"), F.sum("_share")).first()
    factor = size * rows / shares if rows and shares else 0.0
    return counts.select("_source", (F.col("_share") * factor / F.col("_n")).alias("rate"))


def poisson_steps(rate: Column) -> tuple[Column, Column]:
    """The Poisson distribution function of mean `rate` as an array, and of how many such draws a count is the sum.

    The array ends twelve standard deviations past the mean, where what is left is below the spacing of the uniform numbers."""
    parts = F.greatest(F.ceil(rate / MAX_RATE), F.lit(1)).cast("int")
    each = rate / parts
    last = (F.ceil(each + F.sqrt(each) * 12) + 20).cast("int")
    first = F.exp(-each)

    def step(a, k):
        p = a["p"] * each / k
        return F.struct(p.alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + p)).alias("cdf"))

    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["cdf"]), parts


def poisson_count(cdf: Column, parts: Column, *key: Column) -> Column:
    """Invert the distribution at uniform numbers hashed from the key: the steps below each number, summed over the parts."""
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, i: n + F.size(F.filter(cdf, lambda c: c < uniform(*key, i))))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, size: float = 1.0, seed: str = "mix-1") -> DataFrame:
    """docs with each row repeated as often as a Poisson draw of its source's rate says, in a global random order.

    Adds copy (from 0) and shuffle_key (between 0 and 1; the order of the whole output); columns of docs that have these names
    are replaced. A null source is a source of its own. Rows with equal doc_id draw alike; null doc_ids draw as the word null.
    Empty docs give an empty mixture. Only rates are broadcast, if there are few sources; the text moves once, to its place."""
    columns = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    key = F.col("doc_id")
    rates = source_rates(docs, weights, temperature, size)
    steps, parts = poisson_steps(F.col("rate"))
    rates = rates.select("_source", steps.alias("_cdf"), parts.alias("_parts"))
    if docs.select("source").distinct().limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    held = docs.select(F.struct(*columns).alias("_row"), key.alias("_id"), F.col("source").alias("_of"))
    drawn = held.join(rates, F.col("_of").eqNullSafe(F.col("_source")), "inner").select("_row", "_id", poisson_count(F.col("_cdf"), F.col("_parts"), F.lit(seed), F.col("_id")).alias("_count")).where("_count > 0")
    copies = drawn.select("_row", "_id", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)).alias("copy"))
    copies = copies.select("_row.*", "copy", uniform(F.lit(seed), F.col("_id"), F.lit("copy"), F.col("copy")).alias("shuffle_key"))
    return globally_shuffled(copies)


def globally_shuffled(df: DataFrame, key: str = "shuffle_key") -> DataFrame:
    """df ordered by a uniform key over all partitions. The key's range is known, so that no sampling pass is needed: the part
    of [0, 1) that a key falls into is its partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionById(n, F.floor(F.col(key) * n).cast("int"))
    return placed.sortWithinPartitions(key, "doc_id", "copy")


def oracle() -> str:
    """DuckDB SQL for the mixture of documents by default parameters."""
    return """
WITH RECURSIVE counts AS (SELECT source AS s, count(*)::DOUBLE AS n FROM documents GROUP BY source),
totals AS (SELECT sum(n) AS rows, sum(pow(n, 0.7)) AS shares FROM counts),
rates AS (SELECT s, pow(n, 0.7) * (1.0 * rows / shares) / n AS rate FROM counts, totals),
steps(s, rate, k, p, c) AS (
  SELECT s, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL SELECT s, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps WHERE k < ceil(rate + sqrt(rate) * 12) + 20),
cdf AS (SELECT s, list(c ORDER BY k) AS cdf FROM steps GROUP BY s),
drawn AS (
  SELECT d.*, len(list_filter(cdf, lambda c: c < (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null') || '|1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)) AS n
  FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.s),
copies AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n))::INTEGER AS copy FROM drawn WHERE n > 0)
SELECT *, (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null') || '|copy|' || copy), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS shuffle_key
FROM copies"""
