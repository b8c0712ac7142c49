"""Arithmetic on samples and vectors as array functions: downmix, linear resampling, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.sources import views

#: The rate that recordings are brought to.
RATE = 16_000


def downmix(samples: Column, channels: Column) -> Column:
    """16-bit samples of interleaved channels as the means of their frames, from -1 to 1. A last frame that isn't whole is left out;
    fewer than one channel counts as one."""
    n = F.greatest(channels, F.lit(1))
    one = lambda f: F.aggregate(F.slice(samples, (f * n + 1).cast("int"), n.cast("int")), F.lit(0.0), lambda a, x: a + x / 32768.0) / n
    frames = F.floor(F.size(samples) / n).cast("int")
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), F.greatest(frames, F.lit(1)) - 1), one)).otherwise(F.array().cast("array<double>"))


def resample(samples: Column, rate: Column, to: int = RATE) -> Column:
    """Samples at another rate by the line between their two neighbours; the last one has none behind it. At least one sample comes
    out of any, none of none, and samples that have the rate stay as they are."""
    ratio = F.lit(float(to)) / rate

    def made(held):
        size = F.size(held)
        count = F.greatest(F.lit(1), F.floor(size * ratio).cast("int"))

        def at(i):
            place = i / ratio
            first = F.floor(place).cast("int")
            part = place - first
            return F.get(held, first) * (1 - part) + F.get(held, F.least(first + 1, size - 1)) * part

        return F.when((size <= 0) | (rate == to), held).otherwise(F.transform(F.sequence(F.lit(0), count - 1), at))

    # A variable of a lambda is evaluated once, whatever samples is made of.
    return F.element_at(F.transform(F.array(samples), made), 1)


def similarity(a: Column, b: Column) -> Column:
    """The dot product of two unit vectors, from -1 to 1; null where one is null or they have different lengths."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


#: Rates that recordings of the labels have.
RATES = (8_000, 16_000, 22_050, 44_100, 48_000)


def _recordings(spark, sf_dir) -> DataFrame:
    """Vectors as samples of one to three channels."""
    wave = F.transform("embedding", lambda x: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(x.cast("double") * 60_000))).cast("int"))
    return views.read(spark, sf_dir, "embeddings").select("vec_id", wave.alias("samples"), (F.col("label") % 3 + 1).alias("channels"), F.element_at(F.array(*map(F.lit, RATES)), (F.col("label") % 5 + 1).cast("int")).alias("rate"))


def pcm_downmix(spark, sf_dir):
    mono = _recordings(spark, sf_dir).select("vec_id", "channels", downmix(F.col("samples"), F.col("channels")).alias("m"))
    level = F.aggregate("m", F.lit(0.0), lambda a, x: a + F.abs(x)) / F.size("m")
    return mono.select("vec_id", "channels", F.size("m").cast("long").alias("frames"), F.round(level, 6).alias("level"), F.round(F.element_at("m", -1), 9).alias("last"))


def linear_resample(spark, sf_dir):
    made = _recordings(spark, sf_dir).select("vec_id", "rate", resample(downmix(F.col("samples"), F.col("channels")), F.col("rate")).alias("y"))
    return made.select("vec_id", "rate", F.posexplode("y").alias("k", "y")).select("vec_id", "rate", "k", F.round("y", 6).alias("y"))


def cosine_pairs(spark, sf_dir):
    """Turns and the next of their source; vectors of turns of 18 s and more are cut short, so that they fit no other."""
    e = views.turn_embeddings(spark, sf_dir)
    v = F.when(F.col("end_ms") - F.col("start_ms") >= 18_000, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    order = Window.partitionBy("source_id").orderBy("turn_index")
    pairs = e.select("source_id", "turn_index", v.alias("a")).withColumn("b", F.lead("a").over(order)).where("b IS NOT NULL")
    return pairs.select("source_id", "turn_index", F.round(similarity(F.col("a"), F.col("b")), 6).alias("cosine"))


_MONO = """r AS (SELECT vec_id, label % 3 + 1 AS channels, [8000, 16000, 22050, 44100, 48000][label % 5 + 1] AS rate, list_transform(embedding, lambda x: greatest(-32768, least(32767, floor(x::DOUBLE * 60000)::INTEGER))) AS s FROM embeddings),
f AS (SELECT vec_id, channels, rate, k // channels AS frame, sum(s[k + 1] / 32768.0::DOUBLE / channels) AS v FROM (SELECT *, unnest(range(0, len(s) // channels * channels)) AS k FROM r) GROUP BY ALL)"""
OWN = {
    "pcm_downmix": (pcm_downmix, f"WITH {_MONO} SELECT vec_id, channels, count(*) AS frames, round(avg(abs(v)), 6) AS level, round(arg_max(v, frame), 9) AS last FROM f GROUP BY vec_id, channels"),
    "linear_resample": (linear_resample, f"""WITH {_MONO}, n AS (SELECT vec_id, rate, count(*) AS n FROM f GROUP BY ALL),
o AS (SELECT *, k / (16000::DOUBLE / rate) AS x FROM (SELECT *, unnest(range(0, CASE WHEN rate = 16000 THEN n ELSE greatest(1, floor(n * (16000::DOUBLE / rate))::BIGINT) END)) AS k FROM n))
SELECT o.vec_id, o.rate, k::INTEGER AS k, round(a.v * (1 - (x - floor(x))) + b.v * (x - floor(x)), 6) AS y FROM o JOIN f a ON a.vec_id = o.vec_id AND a.frame = floor(x) JOIN f b ON b.vec_id = o.vec_id AND b.frame = least(floor(x) + 1, n - 1)"""),
    "cosine_pairs": (cosine_pairs, """SELECT a.source_id, a.turn_index, CASE WHEN (a.end_ms - a.start_ms >= 18000) = (b.end_ms - b.start_ms >= 18000) THEN CASE WHEN a.end_ms - a.start_ms >= 18000 THEN round(list_dot_product(a.embedding[1:60], b.embedding[1:60]), 6) ELSE round(greatest(-1, least(1, list_dot_product(a.embedding, b.embedding))), 6) END END AS cosine
FROM turn_embeddings a JOIN turn_embeddings b ON a.source_id = b.source_id AND b.turn_index = a.turn_index + 1"""),
}
