"""The streaming forms: segments as they come with progress, the latest event of a key, and settled edits by session windows.

State expires: session windows are sent once the watermark has passed them, days are dropped behind it, and the latest events need none,
as each micro-batch adds its own to a log that is merged when it is read. No micro-batch rewrites what another has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from turnwise.plans.shared import place
from turnwise.sources import views

#: Ours, as the source system has no event-time lateness: how long a stream waits for what is late.
WATERMARK = "10 minutes"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def start(stream: DataFrame, mode: str, path: str, each=None):
    """Start a bounded stream into the table at path and return the query. Each micro-batch writes the folder batch=<its number> in
    place of what an attempt before may have left there, so that a repeated one counts once. each: what is made of a micro-batch."""

    def write(df: DataFrame, batch: int) -> None:
        (each(df) if each else df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(write).start()


def _run(stream: DataFrame, mode: str, label: str, each=None, schema=None) -> DataFrame:
    """Run a bounded stream to its end into a table below spark.checkpoint.dir and return that table, with a column batch."""
    spark, path = stream.sparkSession, place(stream.sparkSession, label)
    schema = schema or stream.schema
    spark.createDataFrame([], schema).write.parquet(f"{path}/batch=-1")
    start(stream, mode, path, each).awaitTermination()
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)


def closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three micro-batches of an event without a user, a day after all others: one lets the watermark pass what a bounded stream ends
    with, and the next sends it."""
    path = place(spark, "closing")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = events.agg(F.max(F.col("ts").cast("timestamp")).alias("last")).select(*(F.expr("last + INTERVAL 1 DAY").alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema))
    for _ in range(3):
        last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events_stream(spark, sf_dir).schema).option("maxFilesPerTrigger", 1).parquet(path)


def settled(events: DataFrame) -> DataFrame:
    """The last event of each run of a user's events that lie less than five minutes apart, once no event can join the run: what
    comes later than the watermark is dropped, and a run's state goes when it is sent."""
    runs = events.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", "5 minutes"), "user_id")
    last = runs.agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x"), F.count("*").alias("events"))
    return last.select("user_id", "x.event_id", "x.event_type", "events")


def daily(events: DataFrame) -> DataFrame:
    """Events and value by user and day; the state of a day goes once the watermark has passed it."""
    day = events.withWatermark("ts", WATERMARK).groupBy("user_id", F.window("ts", "1 day").alias("w"))
    return day.agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100).cast("long")).alias("cents")).select("user_id", F.to_date("w.start").cast("string").alias("day"), "n", "cents")


def newest(events: DataFrame) -> DataFrame:
    """The latest event of each user of a table or a micro-batch."""
    return events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x")).select("user_id", "x.ts", "x.event_id", "x.event_type")


def merged(log: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that a log of updates (with a column batch) leaves: for each key that of the last batch."""
    rest = [c for c in log.columns if c not in (*keys, "batch")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


def progress(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """Segments as they come, with the share of their source that is done, in percent: 100 at most, null where a source has no
    duration. durations: source_id, duration_ms, a static table."""
    known = durations.where("duration_ms > 0")
    return segments.join(known, "source_id", "left").select(
        "source_id", "seg_id", "start_ms", "end_ms", "text", F.when(F.col("duration_ms") > 0, F.round(F.least(F.lit(100.0), F.col("end_ms") / F.col("duration_ms") * 100), 6)).alias("percent")
    )


def stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments read as a stream of files, each sent on with the progress of its source; no state."""
    path = place(spark, "segments")
    found = views.segments(spark, sf_dir).select("source_id", "seg_id", "start_ms", "end_ms", "text")
    found.write.parquet(path)
    held = spark.read.schema(found.schema).parquet(path)
    durations = held.groupBy("source_id").agg(F.max("end_ms").alias("duration_ms"))
    return _run(progress(spark.readStream.schema(found.schema).parquet(path), durations), "append", "progress").drop("batch")


def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled edits, each sent once, in append mode."""
    events = events_stream(spark, sf_dir)
    # What closes the stream is left out behind it: a filter in the stream would be pushed below the watermark.
    return _run(settled(events.unionByName(closing(spark, sf_dir).select(*events.columns))), "append", "settled").where("user_id IS NOT NULL").drop("batch")


def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as they change, in update mode, and from this log the last state of each."""
    return merged(_run(daily(events_stream(spark, sf_dir)), "update", "daily"), ["user_id", "day"])


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user: each micro-batch adds its own to a log, without any state."""
    events = events_stream(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    return newest(_run(events, "append", "latest", newest)).drop("ts")


OWN = {
    "stream_segments": (stream_segments, "SELECT source_id, seg_id, start_ms, end_ms, text, round(end_ms * 100.0::DOUBLE / max(end_ms) OVER (PARTITION BY source_id), 6) AS percent FROM segments"),
    "stream_debounce": (stream_debounce, """WITH e AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS events FROM g GROUP BY user_id, run"""),
    "stream_daily": (stream_daily, "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(floor(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL"),
    "stream_latest": (stream_latest, "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id"),
}
