"""Structure of turns where a share, a sum or a half lies on a bound: whole milliseconds decide, not sums of seconds."""

from turnwise.operators.structure import QUERIES
from turnwise.plans.query import over

SCHEMA = "source_id long, turn_index long, start_ms long, end_ms long, raw_speaker int"
#: Source 1: one speaker has four fifths to the millisecond. Source 2: the share is 0.8390625. Source 3: three speakers, one with a fiftieth.
TURNS = [(1, 0, 0, 23_340, 3), (1, 1, 24_000, 117_360, 9), (2, 0, 0, 21_480, 3), (2, 1, 22_000, 26_120, 9), (3, 0, 0, 98_000, 3), (3, 1, 100_000, 197_990, 9), (3, 2, 198_000, 202_010, 14)]


def answers(spark, name):
    turns = spark.createDataFrame(TURNS, SCHEMA)
    segments = turns.selectExpr("source_id", "turn_index AS seg_id", "start_ms", "end_ms")
    return {r.source_id: r for r in over(spark, QUERIES[name].sql, {"turns": turns, "segments": segments}).collect()}


def test_a_share_of_four_fifths_in_the_choice(spark):
    got = answers(spark, "candidate_selection")
    assert (got[1].p_a, got[1].p_b, got[1].reason, got[1].second_wins) == (2.156, 2.156, "tramo_monopolizado", False)


def test_shares_and_halves_on_a_bound(spark):
    got = answers(spark, "turn_structure")
    assert (got[1].dominant_share, got[1].penalty) == (0.8, 2.156)
    assert got[2].dominant_share == 0.839063
    assert got[3].tiny_speakers == 0
