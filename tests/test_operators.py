"""Literal cases for the operators: blocks, speakers, smoothing, refinement."""

from pyspark.sql import functions as F

from turnwise.functions.scalars import clean_text, srt_stamp
from turnwise.operators import blocks, identity, intervals, sequential


def segments(spark, rows):
    return spark.createDataFrame([(1, i, a, b, t, s, -0.2, 0.05, 1.1) for i, (a, b, t, s) in enumerate(rows)], "source_id long, seg_id long, start_ms long, end_ms long, text string, raw_speaker int, avg_logprob double, no_speech_prob double, compression_ratio double")


def test_blocks_merge_and_cut(spark):
    one = segments(spark, [(0, 3000, "a", 1), (3100, 6000, "b", 1), (6100, 9000, "c", 1)])
    (b,) = blocks.reading_blocks(one).collect()
    assert (b.start_ms, b.end_ms, b.text, b.segment_ids) == (0, 9000, "a b c", "0,1,2")
    assert blocks.reading_blocks(segments(spark, [(0, 1000, "a", 1), (1000, 2000, "b", 2)])).count() == 2
    assert blocks.reading_blocks(segments(spark, [(0, 2000, "a", 1), (4000, 6000, "b", 1)])).count() == 2
    assert blocks.reading_blocks(segments(spark, [(0, 2000, "a", None), (2000, 3000, "b", None), (3000, 3500, " ", 1)])).count() == 1


def test_overlap_assignment_and_ties(spark):
    seg = spark.createDataFrame([(1, 0, 0, 5000), (1, 1, 5000, 10000), (1, 2, 20000, 21000)], "source_id long, seg_id long, start_ms long, end_ms long")
    turns = spark.createDataFrame([(1, 0, 0, 4800, 7), (1, 1, 5100, 10000, 9), (1, 2, 30, 10, 1)], "source_id long, turn_index long, start_ms long, end_ms long, raw_speaker int")
    found = {r.seg_id: r.speaker for r in intervals.assign_speakers(seg, turns, ["source_id", "seg_id"]).collect()}
    assert found == {0: 7, 1: 9, 2: None}
    tie = spark.createDataFrame([(1, 0, 0, 500, 5), (1, 1, 500, 1000, 2)], turns.schema)
    word = spark.createDataFrame([(1, 0, 0, 1000), (1, 1, 1600, 1700), (1, 2, 1651, 1701)], seg.schema)
    found = {r.seg_id: r.speaker for r in intervals.assign_speakers(word, tie, ["source_id", "seg_id"], nearest_ms=650).collect()}
    assert found == {0: 5, 1: 2, 2: None}


def test_long_sources_meet_once_per_pair(spark):
    seg = spark.createDataFrame([(1, 0, 0, 500_000)], "source_id long, seg_id long, start_ms long, end_ms long")
    turns = spark.createDataFrame([(1, 0, 10, 400_000, 3)], "source_id long, turn_index long, start_ms long, end_ms long, raw_speaker int")
    assert intervals.bucketed_overlap(seg, turns, "source_id", 60_000).count() == 1


def test_smoothing():
    assert sequential.smoothed([0, 1, 0], [0, 100, 200], [100, 200, 300]) == [0, 0, 0]
    assert sequential.smoothed([0, 1, 1, 0], [0, 100, 600, 900], [100, 600, 900, 999]) == [0, 1, 1, 0]
    assert sequential.smoothed([None, 1, None], [0, 1, 2], [1, 2, 3]) == [None, 1, None]
    assert sequential.smoothed([], [], []) == []


def restarted(labels, starts, ends):
    """The rule as it reads: runs are made afresh after each join."""
    out = list(labels)
    while True:
        cuts = [0, *(i for i in range(1, len(out)) if out[i] != out[i - 1]), len(out)]
        for a, b, c in zip(cuts, cuts[1:], cuts[2:]):
            if c < len(out) and out[a] is not None and out[a] == out[c] and (c - b < 2 or ends[c - 1] - starts[b] < 350):
                out[b:c] = [out[a]] * (c - b)
                break
        else:
            return out


def test_smoothing_by_the_rule_as_it_reads(spark):
    import random

    rng, rows, want = random.Random(5), [], {}
    for seg in range(300):
        n = rng.randrange(0, 25)
        labels = [rng.choice((None, 0, 0, 1, 1, 2)) for _ in range(n)]
        starts = [k * 120 for k in range(n)]
        ends = [s + rng.randrange(20, 200) for s in starts]
        assert sequential.smoothed(labels, starts, ends) == restarted(labels, starts, ends)
        rows += [(1, seg, k, starts[k], ends[k], labels[k], "x") for k in range(n)]
        want |= {(seg, k): x for k, x in enumerate(restarted(labels, starts, ends))}
    words = spark.createDataFrame(rows, "source_id long, seg_id long, word_idx int, start_ms long, end_ms long, label long, word string")
    assert {(r.seg_id, r.word_idx): r.label for r in sequential.label_smoothing(words).collect()} == want
    assert sequential.label_smoothing(words.limit(0)).count() == 0


def greedy(line, width=100):
    if not line.strip():
        return line
    lines = [""]
    for word in line.split(" "):
        if lines[-1] and len(lines[-1]) + 1 + len(word) > width:
            lines.append(word)
        else:
            lines[-1] += (" " if lines[-1] else "") + word
    return "\n".join(lines)


def test_wrapping(spark):
    import random
    import textwrap

    rng = random.Random(3)
    piece = lambda: rng.choice((" ", " ", "  ", "\n", "-", " - ", "x" * rng.randrange(1, 14), "é" * rng.randrange(60, 104), "palabra", "y" * 250, "\t", "\u00a0", "well-known", "--"))
    texts = ["", " ", "\n", "x" * 100 + " ", "x" * 99 + "  ", " " * 130 + "a", "a" * 5000, *("".join(piece() for _ in range(rng.randrange(1, 90))) for _ in range(600)), "word " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "k long, text string")
    found = {r.k: (r.w, r.f) for r in rows.select("k", sequential.wrapped(F.col("text")).alias("w"), sequential.filled("text").alias("f")).collect()}
    assert found.pop(-1) == (None, None)
    for k, t in enumerate(texts):
        assert found[k][0] == "\n".join(greedy(line) for line in t.split("\n")), repr(t)
    plain = " ".join(["palabra"] * 50)
    assert found.keys() == set(range(len(texts))) and textwrap.fill(plain, 100) == greedy(plain)
    cases = {"uno dos\n\n  \ntres": "uno dos\n\n\ntres", "a" * 98 + " well-known": "a" * 98 + "\nwell-known", "a" * 93 + " well-known": "a" * 93 + " well-\nknown", "b" * 130: "b" * 100 + "\n" + "b" * 30}
    got = spark.createDataFrame([(t,) for t in cases], "text string").select("text", sequential.filled("text").alias("f")).collect()
    assert {r.text: r.f for r in got} == cases


def test_refinement_moves_what_fits_elsewhere(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    turn = lambda i, s, e: (1, i, i * 5000, i * 5000 + 4000, s, e)
    schema = "source_id long, turn_index long, start_ms long, end_ms long, speaker int, embedding array<double>"
    rows = [turn(0, 0, a), turn(1, 0, a), turn(2, 0, b), turn(3, 1, b), turn(4, 1, b)]
    assert {r.turn_index: r.speaker for r in identity.refine(spark.createDataFrame(rows, schema), 3).collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1}
    lone = [turn(0, 0, a), turn(1, 0, a), turn(2, 5, a)]
    assert {r.turn_index: r.speaker for r in identity.refine(spark.createDataFrame(lone, schema), 3).collect()}[2] == 0
    kept = [turn(0, 0, a), turn(1, 0, a), turn(2, 5, c)]
    assert {r.turn_index: r.speaker for r in identity.refine(spark.createDataFrame(kept, schema), 3).collect()}[2] == 5


def test_scalars(spark):
    row = spark.range(1).select(srt_stamp(F.lit(2200)).alias("s"), srt_stamp(F.lit(3723004), ".").alias("v"), srt_stamp(F.lit(-5)).alias("n"), clean_text(F.lit(" a \n\tb c ")).alias("c"), clean_text(F.lit(None).cast("string")).alias("e")).first()
    assert tuple(row) == ("00:00:02,200", "01:02:03.004", "00:00:00,000", "a b c", "")


def test_similarity_reaches_the_end_of_a_source(spark, tmp_path):
    import difflib

    said = [f"Sentence number {'x' * k} is said here." for k in range(1, 31)]
    turns = spark.createDataFrame([(1, 0, "user", " ".join(said[:17])), (1, 1, "assistant", " ".join(said[17:])), (2, 0, "user", "Alone.")], "conv_id long, turn int, role string, text string")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    found = {(r.source_id, r.seg_id): r.similarity for r in sequential.text_similarity_query(spark, str(tmp_path)).collect()}
    assert found == {(1, k): round(difflib.SequenceMatcher(None, said[k].lower(), said[k + 1].lower()).ratio(), 6) for k in range(29)}


def test_filling_holds_few_texts():
    """Results leave in small arrays, in order, whatever the size of the batch."""
    import pyarrow as pa

    texts = [None, "", *(f"uno dos {i} " * 20 for i in range(300))]
    parts = list(sequential.filled.func(iter([pa.array(texts, pa.string()), pa.array(["a"], pa.string())])))
    assert max(map(len, parts)) <= sequential.FEW_TEXTS
    got = [x for p in parts for x in p.to_pylist()]
    assert len(got) == len(texts) + 1 and got[0] is None and got[-1] == "a" and got[5].replace("\n", " ") == texts[5].strip()
