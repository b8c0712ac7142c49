"""Reading blocks: greedy segmentation of a transcript, and what is said about each block."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.plans.query import Query

#: The limits of a block.
MAX_MS, MAX_CHARS, PAUSE_MS, SENTENCE_CHARS = 35_000, 650, 1_400, 180
SENTENCE_END = r"""[.!?…]["'”’)]*$"""


#: Segments of a piece of a run without a hard break, and how many segments a block can have at most: each has a character.
PIECE, WIDEST = 4096, MAX_CHARS // 2 + 2
MEANS = ("avg_logprob", "no_speech_prob", "compression_ratio")


def _cut(start, chars, ends, x_end, x_chars):
    """Whether a segment opens a block behind an open one of which start, characters and the last sentence end are given."""
    return (x_end - start > MAX_MS) | (chars + 1 + x_chars > MAX_CHARS) | (ends & (chars >= SENTENCE_CHARS))


def _exits(key: tuple, piece: pd.DataFrame) -> pd.DataFrame:
    """For each place of a piece, or behind it, where a block may start: at which place behind the piece the first block starts that
    starts there, if one starts here. Every place points at the start of the next block; pointers are followed from the right."""
    piece = piece.sort_values("place")
    size, rows = int((piece["at"] == key[2]).sum()), len(piece)
    start, end, chars, ends = (piece[c].tolist() for c in ("start_ms", "end_ms", "n", "ends"))
    out = list(range(-size, max(WIDEST, rows - size + 1)))
    for i in reversed(range(size)):
        held, j = chars[i], i + 1
        while j < rows and not _cut(start[i], held, ends[j - 1], end[j], chars[j]):
            held += 1 + chars[j]
            j += 1
        out[i] = out[j]
    return pd.DataFrame({"source_id": [key[0]], "_isle": [key[1]], "_piece": [key[2]], "exits": [out[:WIDEST]]})


def _entries(seg: DataFrame) -> DataFrame:
    """source_id, _isle, _piece, _entry: at which place of each piece of a long run the first block starts."""
    first = F.greatest(F.lit(0), F.floor((F.col("place") - WIDEST) / PIECE))
    shared = seg.select("*", F.explode(F.sequence(first.cast("int"), F.col("at"))).alias("_piece"))
    maps = shared.groupBy("source_id", "_isle", "_piece").applyInPandas(_exits, f"source_id {seg.schema['source_id'].dataType.simpleString()}, _isle long, _piece int, exits array<int>")
    lists = maps.groupBy("source_id", "_isle").agg(F.array_sort(F.collect_list(F.struct("_piece", "exits"))).alias("l"))
    walk = F.aggregate("l", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.get(x["exits"], F.element_at(a, -1)))))
    return lists.select("source_id", "_isle", F.posexplode(walk).alias("_piece", "_entry"))


def _mean(items: Column, field: str) -> Column:
    """The mean of a field, added in the order of the list: Spark's own average adds as rows arrive, and a mean that lies on a bound
    would fall on either side of it from run to run."""
    held = F.filter(F.transform(items, lambda x: x[field].cast("double")), lambda v: v.isNotNull())
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, v: a + v) / F.size(held))


def reading_blocks(segments: DataFrame, speaker: str = "raw_speaker") -> DataFrame:
    """One row a block: block, start_ms, end_ms, speaker, text, segment_ids, means of the confidences and review_required.

    Whether a segment opens a block depends on where the open block began, so segments are folded in order. Runs between hard breaks
    (a new speaker or a pause) are folded apart, and long runs in pieces: each tells for every place where a block may start in it
    where the first one behind it starts, so that these pointers, followed from piece to piece, give each its first block. Work
    is linear in the segments, and a long run is spread over tasks."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = segments.withColumn("_t", text).where("_t <> ''").withColumn("_s", F.col(speaker))
    order = Window.partitionBy("source_id").orderBy("start_ms", "end_ms", "seg_id")
    hard = F.row_number().over(order) == 1
    hard = hard | ~F.col("_s").eqNullSafe(F.lag("_s").over(order)) | (F.col("start_ms") - F.lag("end_ms").over(order) >= PAUSE_MS)
    rows = rows.withColumn("_hard", hard.cast("int")).withColumn("_isle", F.sum("_hard").over(order)).drop("_hard")
    within = Window.partitionBy("source_id", "_isle").orderBy("start_ms", "end_ms", "seg_id")
    rows = rows.withColumn("_place", F.row_number().over(within) - 1)
    seg = rows.select("source_id", "_isle", F.col("_place").alias("place"), F.floor(F.col("_place") / PIECE).cast("int").alias("at"), "start_ms", "end_ms", F.length("_t").alias("n"), F.col("_t").rlike(SENTENCE_END).alias("ends"))
    long = seg.where(F.col("place") == PIECE).select("source_id", "_isle")
    entries = _entries(seg.join(long, ["source_id", "_isle"], "left_semi"))
    lists = seg.withColumnRenamed("at", "_piece").groupBy("source_id", "_isle", "_piece").agg(F.array_sort(F.collect_list(F.struct("place", "start_ms", "end_ms", "n", "ends"))).alias("l"))
    lists = lists.join(entries, ["source_id", "_isle", "_piece"], "left").withColumn("_from", F.coalesce("_entry", F.lit(0)) + F.col("_piece") * PIECE)
    own = F.filter("l", lambda x: x["place"] >= F.col("_from"))
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(-1).alias("n"), F.lit(False).alias("ends"), F.array().cast("array<int>").alias("starts"))

    def step(acc, x):
        cut = (acc["n"] < 0) | _cut(acc["a"], acc["n"], acc["ends"], x["end_ms"], x["n"])
        return F.struct(F.when(cut, x["start_ms"]).otherwise(acc["a"]).alias("a"), F.when(cut, x["n"]).otherwise(acc["n"] + 1 + x["n"]).alias("n"), x["ends"].alias("ends"), F.when(cut, F.concat(acc["starts"], F.array(x["place"]))).otherwise(acc["starts"]).alias("starts"))

    starts = lists.select("source_id", "_isle", F.explode(F.aggregate(own, zero, step)["starts"]).alias("_place"), F.lit(1).alias("_new"))
    given = rows.select("source_id", "_isle", "_place", "seg_id").join(starts, ["source_id", "_isle", "_place"], "left")
    number = F.sum(F.coalesce("_new", F.lit(0))).over(Window.partitionBy("source_id").orderBy("_isle", "_place")) - 1
    given = given.select("source_id", "seg_id", number.cast("int").alias("block"))
    joined = rows.join(given, ["source_id", "seg_id"])
    ordered = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "seg_id", F.col("_t").alias("t"), F.col("_s").alias("s"), *MEANS)))
    out = joined.groupBy("source_id", "block").agg(ordered.alias("l")).select("*", *(_mean(F.col("l"), c).alias(c) for c in MEANS))
    review = F.coalesce(F.col("avg_logprob") < -1.0, F.lit(False)) | F.coalesce(F.col("no_speech_prob") > 0.6, F.lit(False)) | F.coalesce(F.col("compression_ratio") > 2.4, F.lit(False))
    return out.select(
        "source_id", "block", F.col("l")[0]["start_ms"].alias("start_ms"), F.element_at("l", -1)["end_ms"].alias("end_ms"), F.col("l")[0]["s"].alias("speaker"),
        F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("text"), F.array_join(F.transform("l", lambda x: x["seg_id"].cast("string")), ",").alias("segment_ids"),
        *((F.round(F.col(c) * 1e6) / 1e6).alias(c) for c in MEANS), review.alias("review_required"),
    )


def reading_blocks_query(spark, sf_dir):
    from turnwise.sources import views

    return reading_blocks(views.segments(spark, sf_dir))


def review_flags(spark, sf_dir):
    """Blocks of a source, and how many are to be reviewed."""
    return reading_blocks_query(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("blocks"), F.sum(F.col("review_required").cast("long")).alias("flagged_blocks"))


def block_confidence(spark, sf_dir):
    """Means of the confidences of the blocks' segments, and their number."""
    n = F.size(F.split("segment_ids", ",")).cast("long").alias("segments")
    return reading_blocks_query(spark, sf_dir).select("source_id", "block", n, "avg_logprob", "no_speech_prob", "compression_ratio")


BLOCKS_CTE = """s AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, seg_id) AS r, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM segments WHERE trim(text) <> ''),
b AS (SELECT source_id, r, seg_id, 0 AS block, start_ms AS a, end_ms AS e, raw_speaker AS sp, length(t) AS n, regexp_matches(t, '[.!?…]["''”’)]*$') AS ends FROM s WHERE r = 1
  UNION ALL SELECT s.source_id, s.r, s.seg_id, CASE WHEN c.cut THEN b.block + 1 ELSE b.block END, CASE WHEN c.cut THEN s.start_ms ELSE b.a END, s.end_ms, s.raw_speaker,
    CASE WHEN c.cut THEN length(s.t) ELSE b.n + 1 + length(s.t) END, regexp_matches(s.t, '[.!?…]["''”’)]*$')
  FROM b JOIN s ON s.source_id = b.source_id AND s.r = b.r + 1, LATERAL (SELECT b.sp IS DISTINCT FROM s.raw_speaker OR s.start_ms - b.e >= 1400 OR s.end_ms - b.a > 35000 OR b.n + 1 + length(s.t) > 650 OR (b.ends AND b.n >= 180) AS cut) c),
blocks AS (SELECT b.source_id, b.block, min(s.start_ms) AS start_ms, arg_max(s.end_ms, b.r) AS end_ms, arg_min(s.raw_speaker, b.r) AS speaker, string_agg(s.t, ' ' ORDER BY b.r) AS text, string_agg(b.seg_id::VARCHAR, ',' ORDER BY b.r) AS segment_ids,
  round(avg(avg_logprob), 6) AS avg_logprob, round(avg(no_speech_prob), 6) AS no_speech_prob, round(avg(compression_ratio), 6) AS compression_ratio,
  avg(avg_logprob) < -1.0 OR avg(no_speech_prob) > 0.6 OR avg(compression_ratio) > 2.4 AS review_required FROM b JOIN s USING (source_id, r) GROUP BY b.source_id, b.block)"""
BLOCKS_ORACLE = f"WITH RECURSIVE {BLOCKS_CTE} SELECT * FROM blocks"
OWN = {
    "review_flags": (review_flags, f"WITH RECURSIVE {BLOCKS_CTE} SELECT source_id, count(*) AS blocks, count(*) FILTER (review_required) AS flagged_blocks FROM blocks GROUP BY source_id"),
    "block_confidence": (block_confidence, f"WITH RECURSIVE {BLOCKS_CTE} SELECT source_id, block, len(string_split(segment_ids, ',')) AS segments, avg_logprob, no_speech_prob, compression_ratio FROM blocks"),
}

QUERIES = {
    "blocks_islands": Query("""WITH c AS (SELECT *, CASE WHEN prev_s = raw_speaker AND greatest(0, start_ms - prev_e) < 1400 THEN 0 ELSE 1 END AS fresh FROM (
  SELECT *, lag(raw_speaker) OVER (PARTITION BY source_id ORDER BY start_ms, seg_id) AS prev_s, lag(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, seg_id) AS prev_e FROM segments) x),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id ORDER BY start_ms, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM c)
SELECT source_id, CAST(block AS BIGINT) AS block, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(raw_speaker) AS speaker, count(*) AS segments FROM i GROUP BY source_id, block"""),
    "full_text": Query("SELECT source_id, trim(regexp_replace(array_join(transform(array_sort(collect_list(struct(seg_id, text))), x -> x.text), ' '), '[ \n\t\r]+', ' ')) AS text FROM segments GROUP BY source_id",
        duck_sql="SELECT source_id, array_to_string(list_filter(regexp_split_to_array(string_agg(text, ' ' ORDER BY seg_id), '[ \n\t\r]'), lambda x: x <> ''), ' ') AS text FROM segments GROUP BY source_id"),
    "segment_normalize": Query("SELECT source_id, coalesce(nullif(seg_id % 5, 0), row_number() OVER (PARTITION BY source_id ORDER BY seg_id) - 1) AS id, seg_id, coalesce(start_ms, 0) AS start_ms, coalesce(end_ms, 0) AS end_ms, trim(text) AS text FROM segments"),
    "speaker_renumber": Query("""WITH f AS (SELECT source_id, raw_speaker, min(seg_id) AS first FROM segments GROUP BY source_id, raw_speaker),
k AS (SELECT source_id AS s, raw_speaker AS r, row_number() OVER (PARTITION BY source_id ORDER BY first) AS place FROM f)
SELECT source_id, seg_id, raw_speaker AS speaker_raw_id, place - 1 AS speaker_id, concat('Persona ', CAST(place AS STRING)) AS speaker FROM segments JOIN k ON source_id = s AND raw_speaker = r"""),
    "identity_display_join": Query("""WITH f AS (SELECT source_id, raw_speaker, min(seg_id) AS first FROM segments GROUP BY source_id, raw_speaker)
SELECT t.source_id, t.turn_index, concat('Persona ', CAST(k.place AS STRING)) AS display_name FROM turns t LEFT JOIN (SELECT source_id, raw_speaker, row_number() OVER (PARTITION BY source_id ORDER BY first) AS place FROM f) k ON t.source_id = k.source_id AND t.raw_speaker = k.raw_speaker"""),
}
