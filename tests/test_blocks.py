"""Reading blocks by a plain fold, with runs cut in pieces of any size."""

import random
import time

import pytest

from turnwise.operators import blocks

SCHEMA = "source_id long, seg_id long, start_ms long, end_ms long, text string, raw_speaker int, avg_logprob double, no_speech_prob double, compression_ratio double"


def plain(rows):
    """(first seg_id, number of segments) of every block of a source."""
    out, open_ = [], None
    for _, seg, a, b, text, who, *_ in sorted(rows, key=lambda r: (r[2], r[3], r[1])):
        t = " ".join(text.split(" ")).strip()
        if not t:
            continue
        if open_ and who == open_["who"] and a - open_["end"] < 1400 and b - open_["start"] <= 35_000 and open_["n"] + 1 + len(t) <= 650 and not (open_["ends"] and open_["n"] >= 180):
            open_["n"] += 1 + len(t)
            out[-1][1] += 1
        else:
            open_ = {"start": a, "n": len(t)}
            out.append([seg, 1])
        open_ |= {"who": who, "end": b, "ends": t[-1] in ".!?"}
    return [tuple(x) for x in out]


def source(k, size, seed):
    at, rows, rng = 0, [], random.Random(seed)
    for i in range(size):
        n = rng.choice([1, 1, 2, 5, 20, 60, 200, 700] if k % 2 else [1, 2, 1, 3])
        text = "".join(rng.choice("abc") for _ in range(n)) + rng.choice(["", ".", "!", ""])
        dur = rng.choice([10, 300, 2000, 9000, 40_000] if k % 3 else [10, 20])
        rows.append((k, i, at, at + dur, rng.choice([text, text, " ", text]), rng.choice([1, 1, 1, 1, 2]) if k % 5 == 0 else None if k % 7 == 0 else 1, -0.1, 0.1, 1.0))
        at += rng.choice([dur, dur // 2, dur + 100, dur + (1400 if k % 5 == 0 else 0)])
    return rows


@pytest.mark.parametrize("piece", [4096, 50, 7])
def test_blocks_by_a_plain_fold(spark, monkeypatch, piece):
    monkeypatch.setattr(blocks, "PIECE", piece)
    rows = [r for k in range(14) for r in source(k, 160, k)]
    got = {}
    for r in blocks.reading_blocks(spark.createDataFrame(rows, SCHEMA)).orderBy("source_id", "block").collect():
        ids = r.segment_ids.split(",")
        got.setdefault(r.source_id, []).append((int(ids[0]), len(ids)))
    assert got == {k: plain([r for r in rows if r[0] == k]) for k in range(14)}


def test_a_long_run_of_one_speaker(spark):
    from pyspark.sql import functions as F

    n = 120_000
    segs = spark.range(0, n, 1, 4).select(F.lit(1).cast("long").alias("source_id"), F.col("id").alias("seg_id"), (F.col("id") * 900).alias("start_ms"), (F.col("id") * 900 + 900).alias("end_ms"), F.concat(F.lit("palabras"), (F.col("id") % 97).cast("string"), F.when(F.col("id") % 5 == 0, ".").otherwise("")).alias("text"), F.lit(1).alias("raw_speaker"), *(F.lit(0.1).alias(c) for c in ("avg_logprob", "no_speech_prob", "compression_ratio")))
    began = time.time()
    got = [(int(r.segment_ids.split(",")[0]), r.segment_ids.count(",") + 1) for r in blocks.reading_blocks(segs).orderBy("block").select("segment_ids").collect()]
    assert time.time() - began < 60
    assert got == plain([(1, i, i * 900, i * 900 + 900, f"palabras{i % 97}" + ("." if i % 5 == 0 else ""), 1) for i in range(n)])


def test_means_are_added_in_order(spark):
    """Three tenths of which the mean is 0.6 exactly: in doubles, the order of adding tells whether it lies above."""
    thirds = [(a / 100, b / 100, (180 - a - b) / 100) for a in range(1, 99) for b in range(82 - min(a, 81), 99) if 0 < 180 - a - b < 100]
    mean = lambda v: ((0.0 + v[0]) + v[1] + v[2]) / 3
    rows = [(k, 2 - i, i * 1000, i * 1000 + 900, "abc", 1, -0.1, p, 1.0) for k, ps in enumerate(thirds) for i, p in enumerate(ps)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # joins then sort by seg_id, as on large tables
    try:
        got = {r.source_id: (r.segment_ids, r.review_required) for r in blocks.reading_blocks(spark.createDataFrame(rows[::-1], SCHEMA)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {k: ("2,1,0", mean(ps) > 0.6) for k, ps in enumerate(thirds)}
