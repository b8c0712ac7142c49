"""Refinement with new identities, and the light pass, against plain Python on small random recordings."""

import numpy as np
import pytest

from turnwise.operators import identity

SCHEMA = "source_id long, turn_index long, start_ms long, end_ms long, speaker int, embedding array<double>"


def cos(a, b):
    return float(np.clip(round(float(np.dot(a, b)), 9), -1, 1))


class Plain:
    """One recording: speakers by turn index, and vectors of the turns that have one."""

    def __init__(self, turns):
        self.at = {t[1]: (t[2], t[3]) for t in turns}
        self.who = {t[1]: t[4] for t in turns}
        self.vec = {t[1]: np.array(t[5]) for t in turns if t[5] is not None and 800 <= t[3] - t[2] < 18000}

    def length(self, i):
        return self.at[i][1] - self.at[i][0]

    def groups(self):
        found = {}
        for i in sorted(self.vec):
            found.setdefault(self.who[i], []).append(i)
        return found

    def voices(self):
        voices = {}
        for who, members in self.groups().items():
            score = {i: np.median([cos(self.vec[i], self.vec[j]) for j in members if j != i]) if len(members) > 1 else 1.0 for i in members}
            middle = self.vec[min(members, key=lambda i: (-round(score[i], 8), i))]
            near = sorted(members, key=lambda i: (-cos(self.vec[i], middle), i))[:3]
            total = np.sum([self.vec[i] for i in near], axis=0)
            voices[who] = total / np.linalg.norm(total)
        return voices

    def rivals(self, i, voices):
        ranked = sorted(((cos(self.vec[i], v), k) for k, v in voices.items() if k != self.who[i]), reverse=True)
        return (ranked[0] if ranked else (-1.0, None)) + (ranked[1][0] if len(ranked) > 1 else -1.0,)

    def suspect(self, pair):
        x, y = pair
        if self.length(x) > 1.35 * self.length(y):
            return y
        if self.length(y) > 1.35 * self.length(x):
            return x
        return y if self.at[x][0] <= self.at[y][0] else x

    def refine(self, last):
        queue, made = [], {}
        for stage in range(1, last + 1):
            voices, moves = self.voices(), {}
            for who, members in self.groups().items():
                if stage == 1 and len(members) == 1:
                    best, to, second = self.rivals(members[0], voices)
                    if to is not None and best >= 0.62 and best - second >= 0.10:
                        moves[members[0]] = to
                if stage in (2, 4) and len(members) == 2:
                    i, pair = self.suspect(members), cos(self.vec[members[0]], self.vec[members[1]])
                    best, to, second = self.rivals(i, voices)
                    if stage == 4:
                        if to is not None and pair < 0.50 and best >= 0.58 and best - pair >= 0.15 and best - second >= 0.10:
                            moves[i] = to
                    elif pair < 0.35:
                        if to is not None and best >= 0.55 and best - second >= 0.12:
                            moves[i] = to
                        elif best < 0.45 and self.length(i) >= 2500:
                            queue.append(i)
                if stage == 3 and len(members) >= 3:
                    for i in members:
                        own, (best, to, second) = cos(self.vec[i], voices[who]), self.rivals(i, voices)
                        if own < 0.50 and to is not None and best >= 0.55 and best - max(second, own) >= 0.12:
                            moves[i] = to
                        elif own < 0.35 and best < 0.45 and self.length(i) >= 2500:
                            queue.append(i)
            self.who |= moves
            if stage == 3:
                queue, number = list(dict.fromkeys(queue)), max(self.who.values()) + 1
                while queue:
                    together = [i for i in queue if i == queue[0] or cos(self.vec[queue[0]], self.vec[i]) >= 0.55]
                    queue = [i for i in queue if i not in together]
                    made |= dict.fromkeys(together, number)
                    number += 1
                self.who |= made
        return self.who, made


def recordings(seed, count):
    """Turns of a few speakers; now and then one speaks with a voice of nobody, or of another."""
    rng, rows = np.random.default_rng(seed), []
    for source in range(count):
        size, at = int(rng.integers(6, 26)), 0
        voices = [np.eye(12)[k] for k in range(12)]
        for i in range(size):
            who = int(rng.integers(0, 4))
            voice = voices[who if rng.random() < 0.6 else int(rng.integers(0, 8))] + rng.normal(0, 0.15, 12)
            dur = int(rng.choice([500, 900, 2400, 2600, 4000, 9000, 18000]))
            rows.append((source, i, at, at + dur, who, None if rng.random() < 0.05 else [float(x) for x in voice / np.linalg.norm(voice)]))
            at += dur + 300
    return rows


@pytest.mark.parametrize("last", [3, 4])
def test_refine_against_plain_python(spark, last):
    rows = recordings(last, 40)
    found = {(r.source_id, r.turn_index): (r.speaker, r.made) for r in identity.refine(spark.createDataFrame(rows, SCHEMA), last).collect()}
    want = {}
    for source in range(40):
        who, made = Plain([r for r in rows if r[0] == source]).refine(last)
        want |= {(source, i): (k, made.get(i)) for i, k in who.items()}
    assert found == want
    assert len({(s, m) for (s, _), (_, m) in found.items() if m is not None}) > 10


def test_candidates_by_rounds(spark):
    """A chain in which each matches the one before: seeds are every other one. No candidate gives no row."""
    turn = np.pi / 3.4
    chain = [(1, i, i + 1, 0, 3000, [float(np.cos(i * turn)), float(np.sin(i * turn))]) for i in range(3)] + [(2, 0, 1, 0, 3000, [1.0, 0.0])]
    schema = "source_id long, turn_index long, k long, start_ms long, end_ms long, embedding array<double>"
    assert sorted((r.source_id, r.k, r.lead) for r in identity.cluster_candidates(spark.createDataFrame(chain, schema)).collect()) == [(1, 1, 1), (1, 2, 1), (1, 3, 3), (2, 1, 1)]
    assert identity.cluster_candidates(spark.createDataFrame([], schema)).count() == 0


def test_light_identity(spark):
    """No more than the sampled vectors count, turns without one stay, and empty tables give no rows."""
    rows = recordings(9, 6)
    turns = spark.createDataFrame(rows, SCHEMA)
    refined, row = identity.light_identity(turns, turns.select("source_id", "end_ms"))
    refined, row = refined.collect(), {r.source_id: r for r in row.collect()}
    assert len(refined) == len(rows) and sorted(row) == list(range(6))
    for source, r in row.items():
        mine = [x for x in refined if x.source_id == source]
        sampled = [x for x in rows if x[0] == source and any(y.turn_index == x[1] and y.embedding is not None for y in mine)]
        assert r.computed == len(sampled) <= r.selected <= 18 and r.eligible + r.skipped_short + r.skipped_long <= len(mine)
        who, made = Plain([(*x[:5], x[5] if x in sampled else None) for x in rows if x[0] == source]).refine(4)
        assert {x.turn_index: x.speaker for x in mine} == who and r.new_identities == len(set(made.values())) and r.speakers_after == len(set(who.values()))
        assert r.overall_confidence in ("baja", "media", "alta") and r.penalty >= 0
    assert identity.light_identity(turns.limit(0), turns.select("source_id", "end_ms"))[1].count() == 0


@pytest.mark.parametrize("block", [1024, 7])
def test_prototypes_in_blocks(spark, monkeypatch, block):
    """Blocks give what the join of all pairs gives."""
    from turnwise.plans.query import over

    monkeypatch.setattr(identity, "BLOCK", block)
    rng = np.random.default_rng(3)
    unit = lambda v: [float(x) for x in v / np.sqrt((v * v).sum())]
    rows = [(k % 2, k, k % 3 if k < 60 else 7, unit(rng.normal(size=5) + k % 3)) for k in range(61)]
    turns = spark.createDataFrame([*rows, *((5, k, 1, [1.0, 0.0, 0.0, 0.0, 0.0]) for k in range(3))], "source_id long, turn_index long, speaker int, embedding array<double>")
    found = identity.prototypes(turns)
    key = lambda df: sorted((r.source_id, r.speaker, r.medoid_index, r.n, tuple(r.proto)) for r in df.collect())
    assert key(found) == key(over(spark, f"WITH {identity._Dialect(True).prototypes('p', 'turns')} SELECT * FROM p", {"turns": turns}))


def test_local_scan_compares_pairs_in_tasks(spark, monkeypatch):
    """The scan's prototypes come from blocks of vectors, not from rows of pairs."""
    from turnwise.operators import local_scan

    asked = []
    whole = local_scan.prototypes
    monkeypatch.setattr(local_scan, "prototypes", lambda t: asked.append(sorted(t.columns)) or whole(t))
    found = local_scan.local_change_scan_query(spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and len(asked) == 1
