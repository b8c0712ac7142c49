"""Transcripts cut where the speaker changes: words take speakers, short flips are smoothed, gaps filled, runs become pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.scalars import word_text
from turnwise.operators.intervals import _duck_speakers, assign_speakers
from turnwise.operators.sequential import SMOOTH_DUCK, label_smoothing
from turnwise.sources import views

NEAREST_MS = 650
_IDS = ["source_id", "seg_id"]


def align_and_split(segments: DataFrame, words: DataFrame, turns: DataFrame) -> DataFrame:
    """The pieces of segments (source_id, seg_id, start_ms, end_ms, text) by words (..., word_idx, start_ms, end_ms, word) and turns.

    A segment with words of both bounds is cut into its runs of one speaker, numbered from 0 by piece, each as long as its words;
    words without a speaker take that of the next run, else of the one before. Any other segment is one piece with the speaker
    of its own bounds. Each piece tells its branch, its words and how many of them had a speaker of their own (both 0 for
    whole segments). Rows are keyed by (source_id, seg_id, piece), and that is their order; nothing is numbered over a source."""
    ids = [*_IDS, "word_idx"]
    timed = words.where("start_ms IS NOT NULL AND end_ms IS NOT NULL").select(*ids, "start_ms", "end_ms", "word")
    own = assign_speakers(timed, turns, ids, nearest_ms=NEAREST_MS).withColumnRenamed("speaker", "label").withColumn("assigned", F.col("label").isNotNull())
    order = Window.partitionBy(*_IDS).orderBy("word_idx")
    behind, before = order.rowsBetween(Window.currentRow, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = label_smoothing(own).withColumn("label", F.coalesce(F.first("label", True).over(behind), F.last("label", True).over(before)))
    fresh = full.withColumn("_new", F.when(F.row_number().over(order) == 1, 0).otherwise((~F.lag("label").over(order).eqNullSafe(F.col("label"))).cast("int")))
    runs = fresh.withColumn("piece", F.sum("_new").over(before)).groupBy(*_IDS, "piece").agg(
        F.min_by("start_ms", "word_idx").alias("start_ms"), F.max_by("end_ms", "word_idx").alias("end_ms"), F.first("label", True).alias("speaker"), F.count("*").alias("words"),
        F.sum(F.col("assigned").cast("long")).alias("assigned"), F.array_sort(F.collect_list(F.struct("word_idx", "word"))).alias("w"),
    )
    columns = [*_IDS, "piece", "branch", "start_ms", "end_ms", "speaker", "words", "assigned", "text"]
    cut = runs.withColumn("branch", F.lit("words")).withColumn("text", word_text(F.col("w.word"))).select(*columns)
    whole = segments.select(*_IDS, "start_ms", "end_ms", "text").join(timed.select(*_IDS).distinct(), _IDS, "left_anti")
    none = F.lit(0).cast("long")
    whole = assign_speakers(whole, turns, _IDS, nearest_ms=NEAREST_MS).select(*_IDS, none.alias("piece"), F.lit("segment").alias("branch"), "start_ms", "end_ms", F.col("speaker").cast("long"), none.alias("words"), none.alias("assigned"), "text")
    return cut.unionByName(whole)


def summary(pieces: DataFrame) -> DataFrame:
    """What align_and_split did to each source: pieces are counted by segment first, so that a long source is summed in parts."""
    each = pieces.groupBy(*_IDS).agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.sum("assigned").alias("assigned"), F.max((F.col("branch") == "segment").cast("long")).alias("whole"))
    total = lambda c: F.sum(c).cast("long")
    return each.groupBy("source_id").agg(
        F.when(F.sum("words") > 0, "word_level").otherwise("segment_fallback").alias("mode"), F.count("*").alias("input_segments"), total("n").alias("output_segments"), total("words").alias("word_count"),
        total("assigned").alias("assigned_words"), total(F.col("words") - F.col("assigned")).alias("unassigned_words"), total("whole").alias("fallback_segments"),
        total((F.col("n") > 1).cast("long")).alias("split_source_segments"), total(F.col("n") - 1).alias("speaker_switches_inside_segments"),
    )


def aligned_segments(spark, sf_dir):
    """Pieces of all segments. Words of up to four letters have no end here, so that some segments have no timed word, and turns are
    1.2 s late, so that segments are cut where they begin."""
    words = views.words(spark, sf_dir).withColumn("end_ms", F.when(F.length("word") > 4, F.col("end_ms")))
    late = views.turns(spark, sf_dir).withColumns({c: F.col(c) + 1200 for c in ("start_ms", "end_ms")})
    return align_and_split(views.segments(spark, sf_dir), words, late)


def alignment_meta(spark, sf_dir):
    return summary(aligned_segments(spark, sf_dir))


_PIECES_DUCK = f"""WITH RECURSIVE drifted AS (SELECT * REPLACE (start_ms + 1200 AS start_ms, end_ms + 1200 AS end_ms) FROM turns),
timed AS (SELECT * FROM words WHERE length(word) > 4),
lab AS (WITH {_duck_speakers('timed', 'source_id, seg_id, word_idx', 2 * NEAREST_MS)} SELECT t.source_id, t.seg_id, t.word_idx, t.start_ms, t.end_ms, coalesce(o.s, n.s)::BIGINT AS label FROM timed t LEFT JOIN overlap o USING (source_id, seg_id, word_idx) LEFT JOIN near n USING (source_id, seg_id, word_idx)),
{SMOOTH_DUCK},
known AS (SELECT * FROM smooth WHERE label IS NOT NULL),
late AS (SELECT s.source_id, s.seg_id, s.word_idx, s.start_ms, s.end_ms, k.label FROM smooth s ASOF LEFT JOIN known k ON s.source_id = k.source_id AND s.seg_id = k.seg_id AND s.word_idx <= k.word_idx),
done AS (SELECT s.source_id, s.seg_id, s.word_idx, s.start_ms, s.end_ms, coalesce(s.label, k.label) AS s FROM late s ASOF LEFT JOIN known k ON s.source_id = k.source_id AND s.seg_id = k.seg_id AND s.word_idx >= k.word_idx),
placed AS (SELECT *, row_number() OVER (PARTITION BY source_id, seg_id ORDER BY word_idx) - row_number() OVER (PARTITION BY source_id, seg_id, s ORDER BY word_idx) AS isle FROM done),
grown AS (SELECT p.source_id, p.seg_id, p.s, isle, min(p.word_idx) AS first_idx, arg_min(p.start_ms, p.word_idx) AS start_ms, arg_max(p.end_ms, p.word_idx) AS end_ms, count(*) AS words, count(l.label) AS assigned, string_agg(t.word, ' ' ORDER BY p.word_idx) AS text
  FROM placed p JOIN lab l USING (source_id, seg_id, word_idx) JOIN timed t USING (source_id, seg_id, word_idx) GROUP BY ALL),
bare AS (WITH {_duck_speakers('(SELECT * FROM segments ANTI JOIN timed USING (source_id, seg_id))', 'source_id, seg_id', 2 * NEAREST_MS)} SELECT g.source_id, g.seg_id, g.start_ms, g.end_ms, g.text, coalesce(o.s, n.s) AS s FROM item g LEFT JOIN overlap o USING (source_id, seg_id) LEFT JOIN near n USING (source_id, seg_id)),
pieces AS (SELECT source_id, seg_id, row_number() OVER (PARTITION BY source_id, seg_id ORDER BY first_idx) - 1 AS piece, 'words' AS branch, start_ms, end_ms, s AS speaker, words, assigned, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM grown
  UNION ALL SELECT source_id, seg_id, 0, 'segment', start_ms, end_ms, s, 0, 0, text FROM bare)""".replace("JOIN turns t", "JOIN drifted t")

OWN = {
    "aligned_segments": (aligned_segments, f"{_PIECES_DUCK}\nSELECT * FROM pieces"),
    "alignment_meta": (alignment_meta, f"""{_PIECES_DUCK}
SELECT source_id, CASE WHEN sum(words) > 0 THEN 'word_level' ELSE 'segment_fallback' END AS mode, count(DISTINCT seg_id) AS input_segments, count(*) AS output_segments, sum(words)::BIGINT AS word_count, sum(assigned)::BIGINT AS assigned_words,
  sum(words - assigned)::BIGINT AS unassigned_words, count(*) FILTER (branch = 'segment') AS fallback_segments, count(*) FILTER (piece = 1) AS split_source_segments, count(*) FILTER (piece > 0) AS speaker_switches_inside_segments FROM pieces GROUP BY source_id"""),
}
