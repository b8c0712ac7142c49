"""What engines and earlier runs left as JSON: results of a speech engine with sentinels, and saved transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.plans.shared import place
from turnwise.sources import views
from turnwise.sources.files import read_files, write_files

#: What an engine writes in the place of JSON, and the message of an error without one.
CANCELLED, ERROR, NO_MESSAGE = "__VTT_CANCELLED__", "__VTT_ERROR__:", "Error del motor nativo"


def _get(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _text(v: Column, name: str, default: str = "") -> Column:
    return F.coalesce(_get(v, name, "string"), F.lit(default))


def _whole(v: Column, name: str) -> Column:
    return F.coalesce(_get(v, name, "bigint"), F.lit(0).cast("long"))


def _objects(v: Column, name: str) -> Column:
    """The objects of a list; what isn't an object is passed over, and what isn't a list is an empty one."""
    return F.filter(F.coalesce(_get(v, name, "array<variant>"), F.array().cast("array<variant>")), lambda x: F.coalesce(F.schema_of_variant(x), F.lit("")).startswith("OBJECT"))


def segments_of(v: Column) -> Column:
    """start_ms, end_ms, text and words of the segments of a result. Bounds of words may be null, those of segments count as 0."""
    word = lambda w: F.struct(_get(w, "startMs", "bigint").alias("start_ms"), _get(w, "endMs", "bigint").alias("end_ms"), _text(w, "text").alias("text"))
    return F.transform(_objects(v, "segments"), lambda s: F.struct(_whole(s, "startMs").alias("start_ms"), _whole(s, "endMs").alias("end_ms"), _text(s, "text").alias("text"), F.transform(_objects(s, "words"), word).alias("words")))


def _parsed(text: Column) -> Column:
    """The object that a text holds, or null."""
    v = F.try_parse_json(text)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def engine_results(outputs: DataFrame) -> DataFrame:
    """outputs with status, message, text and segments in the place of raw, the string that the engine gave back.

    status: ok, cancelled, error (message says why), or corrupt where raw is null or no JSON object. Only ok rows have text and
    segments. White space around raw doesn't count; missing fields are empty, and null bounds of words stay null."""
    raw = F.regexp_replace(F.coalesce("raw", F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    status = F.when(F.col("_raw") == CANCELLED, "cancelled").when(F.col("_raw").startswith(ERROR), "error").when(F.col("_v").isNull(), "corrupt").otherwise("ok")
    own = F.substring("_raw", len(ERROR) + 1, 1 << 30)
    message = F.when(F.col("status") == "error", F.when(F.trim(own) == "", F.lit(NO_MESSAGE)).otherwise(own))
    held = outputs.drop("status", "message", "text", "segments").withColumn("_raw", raw).withColumn("_v", _parsed(F.col("_raw"))).withColumn("status", status)
    good = F.col("status") == "ok"
    return held.withColumns({"message": message, "text": F.when(good, _text(F.col("_v"), "text")), "segments": F.when(good, segments_of(F.col("_v")))}).drop("raw", "_raw", "_v")


def saved_transcripts(files: DataFrame) -> DataFrame:
    """files with status and, in the place of text, the fields of a saved transcript: original, edited, source_name, model, language,
    updated_at, revision and segments.

    status: ok, missing (no text or only blanks), corrupt (no JSON object) or empty (no original text); only ok rows have fields.
    edited and source_name may be null; a missing model is `base`, other missing fields are empty or 0."""
    v = F.col("_v")
    status = F.when(~F.coalesce("text", F.lit("")).rlike(r"\S"), "missing").when(v.isNull(), "corrupt").when(_text(v, "original") == "", "empty").otherwise("ok")
    fields = {
        "original": _text(v, "original"), "edited": _get(v, "edited", "string"), "source_name": _get(v, "sourceName", "string"), "model": _text(v, "model", "base"), "language": _text(v, "language"),
        "updated_at": _whole(v, "updatedAt"), "revision": _whole(v, "revision"), "segments": segments_of(v),
    }
    held = files.drop("status", *fields).withColumn("_v", _parsed(F.col("text"))).withColumn("status", status)
    return held.withColumns({k: F.when(F.col("status") == "ok", x) for k, x in fields.items()}).drop("text", "_v")


def result_json(segments: DataFrame, words: DataFrame) -> DataFrame:
    """source_id, raw: the engine's JSON of segments (source_id, seg_id, start_ms, end_ms, text) and their words (word_idx, word)."""
    word = F.struct(F.col("start_ms").alias("startMs"), F.col("end_ms").alias("endMs"), F.col("word").alias("text"))
    own = words.groupBy("source_id", "seg_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", word.alias("w")))).alias("_w"))
    seg = F.struct(F.col("start_ms").alias("startMs"), F.col("end_ms").alias("endMs"), "text", F.transform("_w", lambda x: x["w"]).alias("words"))
    held = segments.join(own, ["source_id", "seg_id"], "left").groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("seg_id", seg.alias("s")))).alias("_s"))
    listed = F.transform("_s", lambda x: x["s"])
    whole = F.struct(F.array_join(F.transform(listed, lambda s: s["text"]), " ").alias("text"), listed.alias("segments"))
    return held.select("source_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("raw"))


def _last_event(spark, sf_dir) -> DataFrame:
    return views.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source_id")).agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("last"))


def json_parse_segments(spark, sf_dir):
    """The engine's strings of the transcripts, read back. Of a job whose last event is an error the engine gave an error, with the
    event's number or without a message, of one that ends with a sign-up a cancellation, and of one that ends with a view broken
    JSON. Words of one letter have no bounds."""
    bound = lambda c: F.when(F.length("word") > 1, F.col(c)).alias(c)
    words = views.words(spark, sf_dir).select("source_id", "seg_id", "word_idx", "word", bound("start_ms"), bound("end_ms"))
    held = result_json(views.segments(spark, sf_dir), words).join(_last_event(spark, sf_dir), "source_id", "left")
    kind, event = F.col("last.event_type"), F.col("last.event_id")
    error = F.concat(F.lit(f" {ERROR}"), F.when(event % 2 == 0, F.lit("  ")).otherwise(event.cast("string")))
    raw = F.when(kind == "error", error).when(kind == "signup", F.lit(f"{CANCELLED}\n")).when(kind == "view", F.expr("substring(raw, 1, length(raw) - 2)")).otherwise(F.col("raw"))
    found = engine_results(held.select("source_id", raw.alias("raw")))
    flat = F.flatten(F.transform("segments", lambda s: s["words"]))
    count = lambda c: F.when(F.col("status") == "ok", F.size(c).cast("long"))
    return found.select(
        "source_id", "status", "message", "text", count(F.col("segments")).alias("n_segments"), count(flat).alias("n_words"), count(F.filter(flat, lambda w: w["start_ms"].isNull())).alias("n_untimed"),
        F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + s["end_ms"] - s["start_ms"]).alias("spoken_ms"), F.array_max(F.transform(flat, lambda w: w["end_ms"])).alias("last_word_ms"),
    )


PARSE_ORACLE = """WITH s AS (SELECT source_id, string_agg(text, ' ' ORDER BY seg_id) AS text, count(*) AS n_segments, sum(end_ms - start_ms)::BIGINT AS spoken_ms FROM segments GROUP BY source_id),
w AS (SELECT source_id, count(*) AS n_words, count(*) FILTER (length(word) < 2) AS n_untimed, max(end_ms) FILTER (length(word) > 1) AS last_word_ms FROM words GROUP BY source_id),
e AS (SELECT * FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1),
j AS (SELECT *, coalesce(MAP {'error': 'error', 'signup': 'cancelled', 'view': 'corrupt'}[event_type], 'ok') AS status FROM s JOIN w USING (source_id) LEFT JOIN e ON user_id = source_id)
SELECT source_id, status, CASE WHEN status = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'Error del motor nativo' ELSE event_id::VARCHAR END END AS message, CASE WHEN status = 'ok' THEN text END AS text, CASE WHEN status = 'ok' THEN n_segments END AS n_segments,
  CASE WHEN status = 'ok' THEN n_words END AS n_words, CASE WHEN status = 'ok' THEN n_untimed END AS n_untimed, CASE WHEN status = 'ok' THEN spoken_ms END AS spoken_ms, CASE WHEN status = 'ok' THEN last_word_ms END AS last_word_ms FROM j"""


def json_roundtrip(spark, sf_dir):
    """Saved transcripts written as files, a file for each source, and read from them: broken where the job's last event is a view,
    blank where it is a sign-up, and without an original text where it is an error."""
    own = result_json(views.segments(spark, sf_dir), views.words(spark, sf_dir)).join(_last_event(spark, sf_dir), "source_id", "left")
    v, kind = F.parse_json("raw"), F.col("last.event_type")
    body = F.struct(F.when(kind == "error", F.lit("")).otherwise(_text(v, "text")).alias("original"), F.concat(F.lit("/audio/file-"), F.col("source_id").cast("string"), F.lit(".wav")).alias("sourceName"), F.col("source_id").alias("revision"), _get(v, "segments", "variant").alias("segments"))
    whole = F.to_json(body, {"ignoreNullFields": "false"})
    text = F.when(kind == "view", F.expr("substring(_t, 3, 1 << 30)")).when(kind == "signup", F.lit(" \n")).otherwise(F.col("_t"))
    path = place(spark, "transcripts")
    write_files(own.withColumn("_t", whole).select(F.concat(F.lit("t "), F.col("source_id").cast("string"), F.lit(".json")).alias("name"), text.alias("text")), path)
    found = saved_transcripts(read_files(spark, path, "*.json"))
    return found.select(
        F.regexp_extract("name", "[0-9]+", 0).cast("long").alias("source_id"), "status", "original", "edited", "source_name", "model", "revision", F.size("segments").cast("long").alias("n_segments"),
        F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + s["end_ms"] - s["start_ms"]).alias("spoken_ms"),
    )


ROUNDTRIP_ORACLE = """WITH s AS (SELECT source_id, string_agg(text, ' ' ORDER BY seg_id) AS original, count(*) AS n_segments, sum(end_ms - start_ms)::BIGINT AS spoken_ms FROM segments GROUP BY source_id),
e AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id), j AS (SELECT * FROM s LEFT JOIN e ON user_id = source_id), ok AS (SELECT * FROM j WHERE coalesce(last, '') NOT IN ('view', 'signup', 'error'))
SELECT source_id, 'ok' AS status, original, NULL::VARCHAR AS edited, '/audio/file-' || source_id || '.wav' AS source_name, 'base' AS model, source_id AS revision, n_segments, spoken_ms FROM ok
UNION ALL SELECT source_id, CASE last WHEN 'view' THEN 'corrupt' WHEN 'signup' THEN 'missing' ELSE 'empty' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM j WHERE last IN ('view', 'signup', 'error')"""

OWN = {"json_parse_segments": (json_parse_segments, PARSE_ORACLE), "json_roundtrip": (json_roundtrip, ROUNDTRIP_ORACLE)}
