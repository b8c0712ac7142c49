"""Text exports of transcripts: TXT and Markdown of reading blocks, SRT and WebVTT of segments, documents as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.scalars import clean_text, srt_stamp
from turnwise.operators.blocks import BLOCKS_CTE, reading_blocks
from turnwise.sources import views


def _text(df: DataFrame, entry: Column, order: str) -> DataFrame:
    """source_id, text: the entries of a source in order, a blank line apart."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), entry.alias("t"))))
    return df.groupBy("source_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n").alias("text"))


def _ended(text: Column) -> Column:
    return F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n"))


def _simple(ms: Column) -> Column:
    return F.substring_index(srt_stamp(ms), ",", 1)


def txt(blocks: DataFrame, with_times: bool = True) -> DataFrame:
    """blocks (source_id, block, start_ms, speaker name or null, text, review_required): a head line, the text, a blank line."""
    time = F.concat(F.lit("["), _simple(F.col("start_ms")), F.lit("]")) if with_times else F.lit(None).cast("string")
    head = F.concat_ws(" ", time, "speaker", F.when(F.col("review_required"), F.lit("[REVISAR]")))
    entry = F.concat(F.when(head != "", F.concat(head, F.lit("\n"))).otherwise(F.lit("")), clean_text(F.col("text")), F.lit("\n"))
    return _text(blocks, entry, "block").select("source_id", _ended(F.col("text")).alias("text"))


def markdown(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """A document for each of files (source_id, file, model, language, audio_ms, processing_ms) with its blocks as for txt. The speed is
    rounded by its exact binary value, as C and Python do (5.425 lies below the half), not by its shortest decimal."""
    head = F.concat(
        F.lit("### ["), _simple(F.col("start_ms")), F.lit("]"), F.coalesce(F.concat(F.lit(" · **"), "speaker", F.lit("**")), F.lit("")),
        F.when(F.col("review_required"), F.lit(" · ⚠ **REVISAR**")).otherwise(F.lit("")), F.lit("\n\n"), clean_text(F.col("text")), F.lit("\n"),
    )
    body = _text(blocks, head, "block")
    speed = F.when(F.col("processing_ms") > 0, F.col("audio_ms") / F.col("processing_ms")).otherwise(F.lit(0.0))
    lines = [
        F.concat(F.lit("# Transcripción: "), F.regexp_extract("file", r"([^/]*)$", 1)), F.lit(""), F.concat(F.lit("- **Modelo:** "), "model"),
        F.concat(F.lit("- **Idioma:** "), F.when(F.coalesce("language", F.lit("")) != "", F.col("language")).otherwise(F.lit("auto"))),
        F.concat(F.lit("- **Duración:** "), _simple(F.col("audio_ms"))), F.concat(F.lit("- **Procesamiento:** "), _simple(F.col("processing_ms"))),
        F.concat(F.lit("- **Velocidad:** "), F.call_function("format_number", speed, F.lit("0.00")), F.lit("× tiempo real")), F.lit(""), F.lit("## Transcripción"), F.lit(""), F.coalesce("text", F.lit("")),
    ]
    return files.join(body, "source_id", "left").select("source_id", _ended(F.concat_ws("\n", *lines)).alias("text"))


def _cue(mark: str) -> Column:
    name = F.coalesce(F.concat("speaker", F.lit(": ")), F.lit(""))
    return F.concat(srt_stamp(F.col("start_ms"), mark), F.lit(" --> "), srt_stamp(F.col("end_ms"), mark), F.lit("\n"), name, clean_text(F.col("text")), F.lit("\n"))


def srt(segments: DataFrame) -> DataFrame:
    """segments (source_id, place from 0, start_ms, end_ms, speaker name or null, text): numbered cues."""
    return _text(segments, F.concat((F.col("place") + 1).cast("string"), F.lit("\n"), _cue(",")), "place")


def vtt(segments: DataFrame) -> DataFrame:
    """As srt, but without numbers and after the format's head line."""
    return _text(segments, _cue("."), "place").select("source_id", F.concat(F.lit("WEBVTT\n\n"), "text").alias("text"))


def _named_segments(spark, sf_dir) -> DataFrame:
    return views.segments(spark, sf_dir).select("source_id", F.col("seg_id").alias("place"), "start_ms", "end_ms", "text", F.concat(F.lit("Persona "), (F.col("raw_speaker") + 1).cast("string")).alias("speaker"))


def _named_blocks(spark, sf_dir) -> DataFrame:
    return reading_blocks(views.segments(spark, sf_dir)).withColumn("speaker", F.concat(F.lit("Persona "), (F.col("speaker") + 1).cast("string")))


def _files(spark, sf_dir) -> DataFrame:
    sizes = views.segments(spark, sf_dir).groupBy("source_id").agg(F.max("end_ms").alias("audio_ms"), (F.count("*") * 700).alias("processing_ms"))
    return sizes.select("source_id", F.concat(F.lit("/audio/file-"), F.col("source_id").cast("string"), F.lit(".wav")).alias("file"), F.lit("small").alias("model"), F.lit("").alias("language"), "audio_ms", "processing_ms")


_DUCK_STAMP = "printf('%02d:%02d:%02d{}%03d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000)"
_stamp = lambda c, mark: _DUCK_STAMP.format(mark, c=c)
_HM = "printf('%02d:%02d:%02d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60)"
_hm = lambda c: _HM.format(c=c)
_CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_B = f"WITH RECURSIVE {BLOCKS_CTE}"
OWN = {
    "export_txt": (
        lambda spark, sf_dir: txt(_named_blocks(spark, sf_dir)),
        f"{_B} SELECT source_id, rtrim(string_agg('[' || {_hm('start_ms')} || '] Persona ' || (speaker + 1) || CASE WHEN review_required THEN ' [REVISAR]' ELSE '' END || chr(10) || text || chr(10), chr(10) ORDER BY block), chr(10)) || chr(10) AS text FROM blocks GROUP BY source_id",
    ),
    "export_md": (
        lambda spark, sf_dir: markdown(_named_blocks(spark, sf_dir), _files(spark, sf_dir)),
        f"""{_B}, f AS (SELECT source_id, max(end_ms) AS a, count(*) * 700 AS p FROM segments GROUP BY source_id),
m AS (SELECT source_id, string_agg('### [' || {_hm('start_ms')} || '] · **Persona ' || (speaker + 1) || '**' || CASE WHEN review_required THEN ' · ⚠ **REVISAR**' ELSE '' END || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY block) AS body FROM blocks GROUP BY source_id)
SELECT source_id, rtrim('# Transcripción: file-' || source_id || '.wav' || chr(10) || chr(10) || '- **Modelo:** small' || chr(10) || '- **Idioma:** auto' || chr(10) || '- **Duración:** ' || {_hm('a')} || chr(10) || '- **Procesamiento:** ' || {_hm('p')} || chr(10)
  || '- **Velocidad:** ' || printf('%.2f', a / p) || '× tiempo real' || chr(10) || chr(10) || '## Transcripción' || chr(10) || chr(10) || coalesce(body, ''), chr(10)) || chr(10) AS text FROM f LEFT JOIN m USING (source_id)""",
    ),
    "export_srt": (
        lambda spark, sf_dir: srt(_named_segments(spark, sf_dir)),
        f"SELECT source_id, string_agg((seg_id + 1) || chr(10) || {_stamp('start_ms', ',')} || ' --> ' || {_stamp('end_ms', ',')} || chr(10) || 'Persona ' || (raw_speaker + 1) || ': ' || {_CLEAN} || chr(10), chr(10) ORDER BY seg_id) AS text FROM segments GROUP BY source_id",
    ),
    "export_vtt": (
        lambda spark, sf_dir: vtt(_named_segments(spark, sf_dir)),
        f"SELECT source_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_stamp('start_ms', '.')} || ' --> ' || {_stamp('end_ms', '.')} || chr(10) || 'Persona ' || (raw_speaker + 1) || ': ' || {_CLEAN} || chr(10), chr(10) ORDER BY seg_id) AS text FROM segments GROUP BY source_id",
    ),
}
