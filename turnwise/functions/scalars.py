"""Scalar functions on text, time stamps and names, as Column functions and as queries over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.plans.query import Query

#: Fixed values.
EXTENSIONS = ".mp3 .wav .m4a .ogg .flac .mp4 .aac .wma .opus .webm .mkv .avi .mov .m4v .mpeg .mpg .3gp .ts .m2ts .aif .aiff".split()
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()


def clean_text(text: Column) -> Column:
    """One space for each run of white space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def srt_stamp(ms: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm of whole milliseconds; negative ones count as 0."""
    t = F.greatest(ms, F.lit(0))
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("long").cast("string"))).otherwise(x.cast("long").cast("string"))
    return F.concat(two(F.floor(t / 3600000)), F.lit(":"), two(F.floor(t / 60000) % 60), F.lit(":"), two(F.floor(t / 1000) % 60), F.lit(mark), F.lpad((t % 1000).cast("string"), 3, "0"))


def stamp_of_seconds(seconds: Column, mark: str = ",") -> Column:
    """As srt_stamp, of seconds rounded to whole milliseconds, halves to even."""
    return srt_stamp(F.rint(seconds * 1000).cast("long"), mark)


def simple_stamp(seconds: Column) -> Column:
    """HH:MM:SS of seconds cut to whole ones; negative ones count as 0."""
    return F.substring_index(srt_stamp(F.floor(F.greatest(seconds, F.lit(0.0))).cast("long") * 1000), ",", 1)


def has_media_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)).isin(*EXTENSIONS)


#: The lines of a diarization log that hold its times.
TIMERS = {
    "segmentation_seconds": r"segmentation\s+([0-9]+(?:\.[0-9]+)?)\s+s",
    "embedding_seconds": r"embedding\s+([0-9]+(?:\.[0-9]+)?)\s+s",
    "clustering_seconds": r"clustering\s+([0-9]+(?:\.[0-9]+)?)\s+s",
    "sherpa_total_seconds": r"total\s+([0-9]+(?:\.[0-9]+)?)\s+s",
    "sherpa_rtf": r"total\s+[0-9]+(?:\.[0-9]+)?\s+s,\s*audio\s+[0-9]+(?:\.[0-9]+)?\s+s,\s*RTF\s+([0-9]+(?:\.[0-9]+)?)",
}


def timer(log: Column, name: str) -> Column:
    """The last value of a timer in a log, or null."""
    found = F.regexp_extract_all(F.coalesce(log, F.lit("")), F.lit(r"(?i)OfflineSpeakerDiarization:\s*" + TIMERS[name]), 1)
    return F.get(found, F.size(found) - 1).cast("double")


def number(value: Column) -> Column:
    """A text or number as a double of at least 0: what can't be read, null, NaN and infinite count as 0."""
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(F.greatest(x, F.lit(0.0)))


def parse_timers(spark, sf_dir):
    """Logs of jobs, with an earlier pass before the last one, and their timers."""
    from turnwise.sources import views

    two = lambda c: F.format_string("%d.%02d", F.floor(F.col(c) / 100).cast("long"), (F.col(c) % 100).cast("long"))
    line = lambda name, c: F.concat(F.lit(f"OfflineSpeakerDiarization: {name} "), two(c), F.lit(" s"))
    total = F.concat(line("total", "diarization_cs"), F.lit(", audio "), two("audio_cs"), F.lit(" s, RTF "), two("export_cs"))
    log = F.concat_ws("\n", F.lit("OfflineSpeakerDiarization: segmentation 9.75 s"), line("segmentation", "asr_cs"), F.upper(line("embedding", "overhead_cs")), F.lit("clustering 3 s"), total)
    jobs = views.job_metrics(spark, sf_dir).withColumn("log", log)
    return jobs.select("job_id", *(timer(F.col("log"), n).alias(n) for n in TIMERS))


def timed_words(words: Column) -> Column:
    """The words (structs with start_ms and end_ms) of an array that have both bounds."""
    return F.filter(words, lambda w: w["start_ms"].isNotNull() & w["end_ms"].isNotNull())


def word_text(tokens: Column) -> Column:
    """The text of raw tokens in order: as they stand, or with blanks between them if several hold none; white space collapsed."""
    joined = F.trim(F.array_join(tokens, "", ""))
    spaced = F.when((F.size(tokens) > 1) & ~F.contains(joined, F.lit(" ")), F.array_join(F.transform(tokens, lambda t: F.trim(t)), " ", "")).otherwise(joined)
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def inside(files: DataFrame, folders: DataFrame) -> DataFrame:
    """The rows of files (path, ...) that are one of folders (folder) or lie below it; null paths do not.

    Each path is joined by its ancestors, an equality on whole names, so that /tmp/a isn't in /tmp/ab."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    known = folders.select(F.regexp_replace("folder", "/+$", "").alias("_at")).where("_at <> ''").distinct()
    hits = files.select("path", F.explode(above).alias("_at")).join(known, "_at", "left_semi").select("path").distinct()
    return files.join(hits, "path", "left_semi")


def temp_files(spark, sf_dir):
    """Pages of hosts that have five pages and more: the host stands for the temporary folder."""
    from turnwise.sources import views

    files = views.read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    roots = files.select(F.substring_index("path", "/", 3).alias("folder")).groupBy("folder").count().where("count >= 5")
    return inside(files, roots.select("folder")).select("page_id")


def format_timestamps(spark, sf_dir):
    """Stamps of the segments' starts at eight times the speed, so that halves of a millisecond occur."""
    from turnwise.sources import views

    t = F.col("start_ms") / 8000.0
    return views.segments(spark, sf_dir).select("source_id", "seg_id", stamp_of_seconds(t).alias("srt"), stamp_of_seconds(t, ".").alias("vtt"), simple_stamp(t).alias("simple"))


_MS = "round_even(start_ms / 8000.0::DOUBLE * 1000, 0)::BIGINT"
OWN = {
    "format_timestamps": (format_timestamps, f"SELECT source_id, seg_id, strftime(make_timestamp({_MS} * 1000), '%H:%M:%S,%g') AS srt, strftime(make_timestamp({_MS} * 1000), '%H:%M:%S.%g') AS vtt, strftime(make_timestamp(start_ms // 8000 * 1000000), '%H:%M:%S') AS simple FROM segments"),
    "temp_files": (temp_files, "SELECT page_id FROM (SELECT page_id, count(*) OVER (PARTITION BY regexp_extract(url, '^[^/]*//[^/]*')) AS n FROM pages) WHERE n >= 5"),
    "parse_timers": (parse_timers, "SELECT job_id, asr_cs / 100.0::DOUBLE AS segmentation_seconds, NULL::DOUBLE AS clustering_seconds, overhead_cs / 100.0::DOUBLE AS embedding_seconds, diarization_cs / 100.0::DOUBLE AS sherpa_total_seconds, export_cs / 100.0::DOUBLE AS sherpa_rtf FROM job_metrics"),
}


QUERIES = {
    "sentence_end": Query("SELECT source_id, seg_id, text RLIKE '[.!?…][\"\\x27”’)]*$' AS ends FROM segments", duck_sql="SELECT source_id, seg_id, right(rtrim(text, '\"''”’)'), 1) IN ('.', '!', '?', '…') AS ends FROM segments"),
    "sha256_content": Query("SELECT kind, id, sha2(text, 256) AS digest FROM texts", duck=(("sha2(text, 256)", "sha256(text)"),)),
    "spanish_date": Query("SELECT event_id, concat(CAST(day(ts) AS STRING), ' de ', element_at(split('" + ",".join(MONTHS) + "', ','), CAST(month(ts) AS INT)), ' de ', CAST(year(ts) AS STRING), ' ', lpad(CAST(hour(ts) AS STRING), 2, '0'), ':', lpad(CAST(minute(ts) AS STRING), 2, '0')) AS text FROM events",
        duck=(("element_at(split('" + ",".join(MONTHS) + "', ','), CAST(month(ts) AS INT))", "string_split('" + ",".join(MONTHS) + "', ',')[month(ts)]"),)),
}
