"""Pieces of aligned segments against the rules gone through word by word."""

import random

from test_operators import restarted

from turnwise.operators import alignment


def heard(a, b, turns):
    """The speaker of an interval: most overlap, the first met of equals; else the turn round the middle, or the nearest bound."""
    by = {}
    for s, e, who in turns:
        if min(b, e) > max(a, s):
            by[who] = by.get(who, 0) + min(b, e) - max(a, s)
    if by:
        return max(by, key=by.get)
    mid, best = (a + b) / 2, (651, None)
    for s, e, who in turns:
        if s <= mid <= e:
            return who
        best = min(best, (min(abs(mid - s), abs(mid - e)), who), key=lambda x: x[0])
    return best[1] if best[0] <= 650 else None


def gone_through(seg, words, turns):
    timed = [w for w in words if w[1] is not None and w[2] is not None]
    if not timed:
        return [("segment", seg[0], seg[1], heard(seg[0], seg[1], turns), 0, 0, seg[2])]
    own = [heard(a, b, turns) for _, a, b, _ in timed]
    labels = restarted(own, [w[1] for w in timed], [w[2] for w in timed])
    filled = [next((x for x in [*labels[i:], *labels[:i][::-1]] if x is not None), None) for i in range(len(labels))]
    cuts = [0, *(i for i in range(1, len(filled)) if filled[i] != filled[i - 1]), len(filled)]
    return [("words", timed[a][1], timed[b - 1][2], filled[a], b - a, sum(x is not None for x in own[a:b]), " ".join(w[3] for w in timed[a:b])) for a, b in zip(cuts, cuts[1:])]


def test_pieces_by_the_rules(spark):
    rng = random.Random(11)
    segments, words, turns, want = [], [], [], {}
    for source in range(12):
        own, t = [], 0
        for i in range(rng.randrange(0, 14)):
            t += rng.randrange(0, 1500)
            own.append((t, t + rng.choice((-50, 200, 400, 900, 3000)), rng.randrange(3)))
        turns += [(source, i, *x) for i, x in enumerate(own)]
        valid = sorted((x for x in own if x[1] > x[0]), key=lambda x: x[:2])
        t = 0
        for seg in range(rng.randrange(1, 9)):
            said, start = [], t
            for k in range(rng.choice((0, 1, 6, 14))):
                said.append((k, rng.choice((t, t, t, None)), t + rng.randrange(60, 300), f"w{k}"))
                t += rng.randrange(100, 500)
            segments.append((source, seg, start, t + 10, f"text {seg}"))
            words += [(source, seg, *w) for w in said]
            want |= {(source, seg, p): row for p, row in enumerate(gone_through((start, t + 10, f"text {seg}"), said, valid))}
            t += rng.randrange(0, 1200)
    ids = "source_id long, seg_id long, "
    tables = spark.createDataFrame(segments, ids + "start_ms long, end_ms long, text string"), spark.createDataFrame(words, ids + "word_idx int, start_ms long, end_ms long, word string")
    at = spark.createDataFrame(turns, "source_id long, turn_index long, start_ms long, end_ms long, raw_speaker int")
    pieces = alignment.align_and_split(*tables, at)
    found = {(r.source_id, r.seg_id, r.piece): (r.branch, r.start_ms, r.end_ms, r.speaker, r.words, r.assigned, r.text) for r in pieces.collect()}
    assert {k: (found.get(k), v) for k, v in want.items() if found.get(k) != v} == {} and len(found) == len(want)
    assert {r[0] for r in want.values()} == {"words", "segment"} and any(r[5] < r[4] for r in want.values())
    totals = {r.source_id: r for r in alignment.summary(pieces).collect()}
    for source in {s for s, _, _ in want}:
        rows = {k: v for k, v in want.items() if k[0] == source}
        r = totals[source]
        assert (r.output_segments, r.input_segments, r.word_count) == (len(rows), len({k[1] for k in rows}), sum(v[4] for v in rows.values()))
        assert (r.mode == "word_level") == (r.word_count > 0) and r.fallback_segments == sum(v[0] == "segment" for v in rows.values())
        assert r.speaker_switches_inside_segments == sum(k[2] > 0 for k in rows) and r.unassigned_words == sum(v[4] - v[5] for v in rows.values())


def test_nothing_and_no_turns(spark):
    segments = spark.createDataFrame([(1, 0, 0, 1000, "a b")], "source_id long, seg_id long, start_ms long, end_ms long, text string")
    words = spark.createDataFrame([(1, 0, 0, 0, 400, "a"), (1, 0, 1, 400, 900, "b")], "source_id long, seg_id long, word_idx int, start_ms long, end_ms long, word string")
    turns = spark.createDataFrame([], "source_id long, turn_index long, start_ms long, end_ms long, raw_speaker int")
    (row,) = alignment.align_and_split(segments, words, turns).collect()
    assert (row.piece, row.speaker, row.words, row.assigned, row.text) == (0, None, 2, 0, "a b")
    assert alignment.align_and_split(segments.limit(0), words.limit(0), turns).count() == 0
