"""Tables of the engine, derived from the driver's tables: in Spark as DataFrames, in DuckDB as common table expressions.

Times are whole milliseconds and money whole hundredths, so that both engines agree to the last digit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How long turns of the embedding table last, in turn.
DURATIONS_MS = (500, 1000, 2000, 3000, 6000, 12000, 20000)
SPEAKERS = {"user": 3, "assistant": 9, "system": 14}
CHUNK_MS, STEP_MS = 90_000, 88_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a sentence of a conversation, laid on a timeline of its own."""
    turns = read(spark, sf_dir, "conversations")
    parts = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\u0001"), "\u0001")
    rows = turns.select(F.col("conv_id").alias("source_id"), "turn", "role", F.posexplode(parts).alias("i", "text")).where("text <> ''")
    n = F.length("text").cast("long")
    gap = F.when((F.col("source_id") * 7 + F.col("turn") * 13 + F.col("i") * 3) % 5 == 0, 1500).otherwise(300)
    order = Window.partitionBy("source_id").orderBy("turn", "i")
    rows = rows.withColumn("dur", n * 60).withColumn("gap", gap)
    start = F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    speaker = F.coalesce(*(F.when(F.col("role") == k, v) for k, v in SPEAKERS.items()), F.lit(0))
    return rows.select(
        "source_id", (F.row_number().over(order) - 1).cast("long").alias("seg_id"), "turn", start.cast("long").alias("start_ms"), (start + F.col("dur")).cast("long").alias("end_ms"), "text",
        speaker.cast("int").alias("raw_speaker"), (-(n * 7 % 160) / 100.0).alias("avg_logprob"), ((n * 11 % 90) / 100.0).alias("no_speech_prob"), (((n * 13 % 190) + 100) / 100.0).alias("compression_ratio"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the segments; the time of a segment is shared out evenly."""
    found = segments(spark, sf_dir).withColumn("w", F.split("text", " "))
    at = found.select("source_id", "seg_id", "start_ms", "end_ms", F.size("w").alias("n"), F.posexplode("w").alias("word_idx", "word"))
    span = F.col("end_ms") - F.col("start_ms")
    place = lambda k: (F.col("start_ms") + F.floor(span * k / F.col("n"))).cast("long")
    return at.select("source_id", "seg_id", "word_idx", place(F.col("word_idx")).alias("start_ms"), place(F.col("word_idx") + 1).alias("end_ms"), "word")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a turn, its bounds moved so that turns overlap and leave gaps; some are inverted and not valid."""
    spans = segments(spark, sf_dir).groupBy("source_id", "turn", "raw_speaker").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    move = (F.col("turn") * 5 % 4 - 1) * 200
    order = Window.partitionBy("source_id").orderBy("turn")
    return spans.select("source_id", (F.row_number().over(order) - 1).cast("long").alias("turn_index"), (F.col("a") + move).alias("start_ms"), (F.col("b") - move).alias("end_ms"), "raw_speaker")


def turn_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with unit vectors: the table's vectors drawn towards the basis vector of their label, by a strength that cycles."""
    e = read(spark, sf_dir, "embeddings")
    strength = (F.col("vec_id") % 8) * 0.2 + 0.6
    mixed = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == F.col("label"), strength).otherwise(0.0))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    dur = F.element_at(F.array(*(F.lit(d) for d in DURATIONS_MS)), (F.col("vec_id") % 7 + 1).cast("int"))
    order = Window.partitionBy("source_id").orderBy("vec_id")
    rows = e.select((F.col("vec_id") % 20).alias("source_id"), "vec_id", F.col("label").alias("speaker"), mixed.alias("_v"), dur.cast("long").alias("d")).withColumn("embedding", F.transform("_v", lambda x: x / norm))
    start = F.coalesce(F.sum(F.col("d") + 400).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return rows.select("source_id", (F.row_number().over(order) - 1).cast("long").alias("turn_index"), start.alias("start_ms"), (start + F.col("d")).alias("end_ms"), "speaker", "embedding")


#: Vectors of a speaker and of a source that identities are made from.
MOST_OF_SPEAKER, MOST_OF_SOURCE = 8, 64


def sampled(turns: DataFrame, per_speaker: int = MOST_OF_SPEAKER, total: int = MOST_OF_SOURCE) -> DataFrame:
    """turns (source_id, turn_index, start_ms, end_ms, speaker, embedding) with null in the place of vectors that aren't used: of the
    turns of 0.8 to 18 s a speaker's first, last and longest count, and of those the longest of the source."""
    length = F.col("end_ms") - F.col("start_ms")
    own = Window.partitionBy("source_id", "speaker", "_ok")
    first, last = F.row_number().over(own.orderBy("start_ms", "turn_index")) == 1, F.row_number().over(own.orderBy(F.desc("start_ms"), F.desc("turn_index"))) == 1
    rows = turns.withColumn("_ok", F.coalesce((length >= 800) & (length < 18_000) & F.col("embedding").isNotNull(), F.lit(False))).withColumn("_rank", F.when(first, 0).when(last, 1).otherwise(2))
    rows = rows.withColumn("_pick", F.col("_ok") & (F.row_number().over(own.orderBy("_rank", F.desc(length), "turn_index")) <= per_speaker))
    rows = rows.withColumn("_pick", F.col("_pick") & (F.row_number().over(Window.partitionBy("source_id", "_pick").orderBy(F.desc(length), "speaker", "turn_index")) <= total))
    return rows.withColumn("embedding", F.when(F.col("_pick"), F.col("embedding"))).select(*turns.columns)


def sampled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turn_embeddings with the vectors that identities are made from."""
    return sampled(turn_embeddings(spark, sf_dir))


def job_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage times of a job, in hundredths of a second."""
    e = read(spark, sf_dir, "events")
    cents = F.floor(F.col("value") * 100).cast("long")
    stage = lambda kind: F.coalesce(F.sum(F.when(F.col("event_type") == kind, cents)), F.lit(0)).cast("long")
    return e.groupBy(F.col("user_id").alias("job_id")).agg(
        (F.count("*") * 1000).cast("long").alias("audio_cs"), stage("error").alias("model_load_cs"), stage("click").alias("asr_cs"), stage("view").alias("diarization_cs"), stage("purchase").alias("export_cs"), stage("signup").alias("overhead_cs")
    )


def chunk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as windows of 90 s every 88 s hear them, each as often as windows hold it."""
    s = segments(spark, sf_dir)
    n = s.groupBy("source_id").agg(F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(0), F.max("end_ms") - 2000) / STEP_MS)).cast("long").alias("n"))
    last = F.least(F.floor((F.col("end_ms") - 1) / STEP_MS), F.col("n") - 1)
    first = F.least(F.greatest(F.lit(0), F.floor((F.col("start_ms") - CHUNK_MS) / STEP_MS) + 1), last)
    at = s.join(n, "source_id").select("source_id", "seg_id", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("chunk_idx"), "start_ms", "end_ms", "text")
    shift = F.col("chunk_idx") * STEP_MS
    return at.select("source_id", "seg_id", "chunk_idx", shift.alias("chunk_start_ms"), (F.col("start_ms") - shift).alias("local_start_ms"), (F.col("end_ms") - shift).alias("local_end_ms"), "text")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda t, k, c: read(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(k).alias("id"), F.col(c).alias("text"))
    return pick("documents", "doc_id", "text").unionByName(pick("benchmark", "item_id", "text"))


VIEWS = {f.__name__: f for f in (segments, words, turns, turn_embeddings, sampled_turns, job_metrics, chunk_segments, texts)}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: The same views for DuckDB, each after those that it reads.
DUCK = {
    "segments": """segments AS (SELECT source_id, (row_number() OVER w - 1)::BIGINT AS seg_id, turn, start_ms, start_ms + dur AS end_ms, text, raw_speaker, avg_logprob, no_speech_prob, compression_ratio FROM (
  SELECT *, coalesce(sum(dur + gap) OVER (PARTITION BY source_id ORDER BY turn, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM (
    SELECT source_id, turn, i, text, (length(text) * 60)::BIGINT AS dur, CASE WHEN (source_id * 7 + turn * 13 + i * 3) % 5 = 0 THEN 1500 ELSE 300 END AS gap,
      CASE role WHEN 'user' THEN 3 WHEN 'assistant' THEN 9 WHEN 'system' THEN 14 ELSE 0 END AS raw_speaker,
      -(length(text) * 7 % 160) / 100.0::DOUBLE AS avg_logprob, (length(text) * 11 % 90) / 100.0::DOUBLE AS no_speech_prob, (length(text) * 13 % 190 + 100) / 100.0::DOUBLE AS compression_ratio
    FROM (SELECT source_id, turn, role, i, parts[i + 1] AS text FROM (SELECT *, unnest(range(0, len(parts))) AS i FROM (
      SELECT conv_id AS source_id, turn, role, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM conversations))) WHERE text <> ''))
  WINDOW w AS (PARTITION BY source_id ORDER BY turn, i))""",
    "words": """words AS (SELECT source_id, seg_id, i::INTEGER AS word_idx, start_ms + floor((end_ms - start_ms) * i / n)::BIGINT AS start_ms, start_ms + floor((end_ms - start_ms) * (i + 1) / n)::BIGINT AS end_ms, w[i + 1] AS word
  FROM (SELECT *, unnest(range(0, n)) AS i FROM (SELECT *, string_split(text, ' ') AS w, len(string_split(text, ' ')) AS n FROM segments)))""",
    "turns": """turns AS (SELECT source_id, (row_number() OVER (PARTITION BY source_id ORDER BY turn) - 1)::BIGINT AS turn_index, a + (turn * 5 % 4 - 1) * 200 AS start_ms, b - (turn * 5 % 4 - 1) * 200 AS end_ms, raw_speaker
  FROM (SELECT source_id, turn, raw_speaker, min(start_ms) AS a, max(end_ms) AS b FROM segments GROUP BY ALL))""",
    "turn_embeddings": """turn_embeddings AS (SELECT source_id, turn_index, start_ms, start_ms + d AS end_ms, speaker, list_transform(v, lambda x: x / norm) AS embedding FROM (
  SELECT *, (row_number() OVER (PARTITION BY source_id ORDER BY vec_id) - 1)::BIGINT AS turn_index, coalesce(sum(d + 400) OVER (PARTITION BY source_id ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms,
    sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM (
    SELECT vec_id % 20 AS source_id, vec_id, label AS speaker, [500, 1000, 2000, 3000, 6000, 12000, 20000][vec_id % 7 + 1]::BIGINT AS d,
      list_transform(embedding, lambda x, i: x::DOUBLE + CASE WHEN i - 1 = label THEN (vec_id % 8) * 0.2::DOUBLE + 0.6::DOUBLE ELSE 0 END) AS v FROM embeddings)))""",
    "sampled_turns": f"""sampled_turns AS (WITH ok AS (SELECT *, end_ms - start_ms AS d FROM turn_embeddings WHERE end_ms - start_ms BETWEEN 800 AND 17999 AND embedding IS NOT NULL),
  ends AS (SELECT source_id, speaker, arg_min(turn_index, start_ms) AS a, arg_max(turn_index, start_ms) AS z FROM ok GROUP BY ALL),
  few AS (SELECT ok.* FROM ok JOIN ends USING (source_id, speaker) QUALIFY row_number() OVER (PARTITION BY source_id, speaker ORDER BY turn_index NOT IN (a, z), turn_index <> a, d DESC, turn_index) <= {MOST_OF_SPEAKER}),
  chosen AS (SELECT source_id, turn_index FROM few QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY d DESC, speaker, turn_index) <= {MOST_OF_SOURCE})
  SELECT t.* REPLACE (CASE WHEN s.turn_index IS NOT NULL THEN embedding END AS embedding) FROM turn_embeddings t LEFT JOIN chosen s ON s.source_id = t.source_id AND s.turn_index = t.turn_index)""",
    "job_metrics": "job_metrics AS (SELECT user_id AS job_id, (count(*) * 1000)::BIGINT AS audio_cs, " + ", ".join(
        f"coalesce(sum(CASE WHEN event_type = '{k}' THEN floor(value * 100)::BIGINT END), 0)::BIGINT AS {v}" for k, v in (("error", "model_load_cs"), ("click", "asr_cs"), ("view", "diarization_cs"), ("purchase", "export_cs"), ("signup", "overhead_cs"))
    ) + " FROM events GROUP BY user_id)",
    "chunk_segments": """chunk_segments AS (SELECT source_id, seg_id, j AS chunk_idx, j * 88000 AS chunk_start_ms, start_ms - j * 88000 AS local_start_ms, end_ms - j * 88000 AS local_end_ms, text
  FROM (SELECT *, unnest(range(least(greatest(0, floor((start_ms - 90000) / 88000) + 1)::BIGINT, last), last + 1)) AS j FROM (
    SELECT s.*, least(floor((end_ms - 1) / 88000), n - 1)::BIGINT AS last FROM segments s JOIN (SELECT source_id, greatest(1, ceil(greatest(0, max(end_ms) - 2000) / 88000))::BIGINT AS n FROM segments GROUP BY source_id) USING (source_id))))""",
    "texts": "texts AS (SELECT 'documents' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark)",
}
NEEDS = {"sampled_turns": ("turn_embeddings",), "words": ("segments",), "turns": ("segments",), "chunk_segments": ("segments",)}
