"""Streams over many micro-batches: state stays flat, late events are dropped, repeated batches count once."""

import datetime
import time

from pyspark.sql import functions as F

from turnwise.streaming import streams

SCHEMA = "user_id long, event_id long, ts timestamp, event_type string, value double"
DAY = datetime.datetime(2024, 1, 1)


def feed(spark, path, batches):
    """A folder with a file a batch, in order."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def states(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]], sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"])


def row(user, event, minute, value=1.0):
    return (user, event, DAY + datetime.timedelta(minutes=minute), f"k{event}", value)


def test_settled_runs_expire(spark, tmp_path):
    """Twelve hours, an hour a file: every user edits in two runs an hour. The eighth file holds an event that is too late."""
    batches = [[row(u, 100 * h + u * 10 + k, 60 * h + m) for u in range(5) for k, m in enumerate((0, 3, 4, 20, 24.9))] for h in range(12)]
    batches[7].append(row(0, 9999, 30))
    batches += [[row(None, 0, 60 * 40)]] * 2
    query = streams.start(streams.settled(feed(spark, str(tmp_path / "in"), batches)), "append", str(tmp_path / "out"))
    query.awaitTermination()
    sizes, dropped = states(query)
    assert len(sizes) >= 12 and max(sizes) <= 25 and dropped == 1
    found = sorted((r.user_id, r.event_id, r.events) for r in spark.read.parquet(str(tmp_path / "out")).where("user_id IS NOT NULL").collect())
    assert found == sorted((u, 100 * h + u * 10 + k, n) for u in range(5) for h in range(12) for k, n in ((2, 3), (4, 2)))


def test_days_expire_and_the_log_is_merged(spark, tmp_path):
    batches = [[row(u, i, 60 * 12 * i + u, 1.25) for u in range(4)] for i in range(12)]
    batches[9].append(row(1, 500, 5, 100.0))
    path = str(tmp_path / "out")
    query = streams.start(streams.daily(feed(spark, str(tmp_path / "in"), batches)), "update", path)
    query.awaitTermination()
    sizes, dropped = states(query)
    assert max(sizes) <= 8 and dropped == 1
    log = spark.read.parquet(path)
    assert sorted(map(tuple, streams.merged(log, ["user_id", "day"]).collect())) == [(u, f"2024-01-{d + 1:02d}", 2, 250) for u in range(4) for d in range(6)]
    assert log.count() == 48


def test_latest_without_state(spark, tmp_path):
    batches = [[row(u, 10 * i + u, (7 * i) % 12 * 60 + u) for u in range(3)] for i in range(12)]
    stream, path = feed(spark, str(tmp_path / "in"), batches), str(tmp_path / "out")
    query = streams.start(stream.select("user_id", "ts", "event_id", "event_type"), "append", path, streams.newest)
    query.awaitTermination()
    assert not any(p["stateOperators"] for p in query.recentProgress)
    log = spark.read.parquet(path)
    again = spark.read.parquet(f"{path}/batch=3")
    assert log.count() == 36 and again.count() == 3
    want = [(u, max((x for b in batches for x in b if x[0] == u), key=lambda x: (x[2], x[1]))[1]) for u in range(3)]
    assert sorted((r.user_id, r.event_id) for r in streams.newest(log).collect()) == want == sorted((r.user_id, r.event_id) for r in streams.newest(log.unionByName(log)).collect())


def test_merged_keeps_the_last_batch(spark):
    rows = [(1, "a", 5, 0), (1, "a", 7, 2), (1, "a", 6, 1), (2, None, 1, 0), (2, None, 3, 3)]
    got = streams.merged(spark.createDataFrame(rows, "user_id int, day string, n int, batch long"), ["user_id", "day"])
    assert sorted((r.user_id, r.n) for r in got.collect()) == [(1, 7), (2, 3)] and got.where(F.col("day").isNull()).count() == 1
