"""Speaker identity: prototypes, rivals, refinement stage by stage, and what is said about each identity.

Vectors stay in Spark: dot products are array functions, prototypes come from a join inside each (source, speaker), rivals from a
join of turns with the prototypes of their source."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.plans.query import Query, over
from turnwise.plans.shared import written
from turnwise.sources import views

#: Turns that are long enough to have a voice and short enough to be one.
_E0 = "e0 AS (SELECT source_id, turn_index, start_ms, end_ms, speaker, embedding FROM turn_embeddings WHERE end_ms - start_ms >= 800 AND end_ms - start_ms < 18000 AND embedding IS NOT NULL)"


#: Fixed value: how long what becomes a new identity must speak, in milliseconds.
NEW_MS = 2500
_VOICED = "end_ms - start_ms >= 800 AND end_ms - start_ms < 18000 AND embedding IS NOT NULL"
_START = "source_id, turn_index, start_ms, end_ms, speaker, embedding, speaker AS was, CAST(NULL AS INT) AS made, CAST(NULL AS INT) AS c_stage, CAST(NULL AS BIGINT) AS c_first"
_CANDIDATE = "source_id, turn_index, start_ms, end_ms, embedding, row_number() OVER (PARTITION BY source_id ORDER BY c_stage, c_first, turn_index) AS k"
_OVERALL = """counts AS (SELECT source_id, CAST(sum(CASE WHEN confidence = 'baja' THEN 1 ELSE 0 END) AS BIGINT) AS low, CAST(sum(CASE WHEN confidence = 'media' THEN 1 ELSE 0 END) AS BIGINT) AS medium, CAST(sum(CASE WHEN confidence IN ('sin_datos', 'insuficiente') THEN 1 ELSE 0 END) AS BIGINT) AS insufficient, count(identity_warning) AS warnings FROM verdict GROUP BY source_id),
overall AS (SELECT source_id, low, medium, insufficient, warnings, CASE WHEN low > 0 THEN 'baja' WHEN medium > 0 OR insufficient > 0 THEN 'media' ELSE 'alta' END AS overall_confidence, round(CAST(low * 1.5 + medium * 0.35 + least(insufficient, 4) * 0.12 + warnings * 0.75 AS DOUBLE), 6) AS penalty FROM counts)"""


class _Dialect:
    """The few array functions that Spark and DuckDB spell differently."""

    def __init__(self, spark: bool):
        self.spark = spark

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, x) -> s + x)" if self.spark else f"list_dot_product({a}, {b})"

    def sim(self, a: str, b: str) -> str:
        return f"greatest(-1.0, least(1.0, round({self.dot(a, b)}, 9)))"

    def unit(self, v: str) -> str:
        return f"transform({v}, q -> q / sqrt({self.dot(v, v)}))" if self.spark else f"list_transform({v}, lambda q: q / sqrt({self.dot(v, v)}))"

    def sum3(self) -> str:
        if self.spark:
            return "transform(v1, (x, i) -> x + coalesce(get(v2, i), 0) + coalesce(get(v3, i), 0))"
        return "list_transform(v1, lambda x, i: x + coalesce(v2[i], 0) + coalesce(v3[i], 0))"

    def at(self, v: str, i: int) -> str:
        return f"{v}[{i}]" if self.spark else f"{v}[{i + 1}]"

    def prototypes(self, name: str, src: str) -> str:
        """The medoid by median cosine, then the renormalised mean of the three nearest to it, itself included."""
        return f"""{name}_s AS (SELECT a.source_id, a.speaker, a.turn_index, median({self.sim('a.embedding', 'b.embedding')}) AS score FROM {src} a
  LEFT JOIN {src} b ON a.source_id = b.source_id AND a.speaker = b.speaker AND a.turn_index <> b.turn_index GROUP BY a.source_id, a.speaker, a.turn_index),
{name}_m AS (SELECT q.source_id, q.speaker, q.turn_index AS medoid_index, e.embedding AS medoid FROM (SELECT *, row_number() OVER (PARTITION BY source_id, speaker ORDER BY round(coalesce(score, 1.0), 8) DESC, turn_index) AS r FROM {name}_s) q JOIN {src} e ON q.source_id = e.source_id AND q.turn_index = e.turn_index WHERE r = 1),
{name}_r AS (SELECT s.source_id, s.speaker, s.embedding, medoid_index, row_number() OVER (PARTITION BY s.source_id, s.speaker ORDER BY {self.sim('s.embedding', 'medoid')} DESC, s.turn_index) AS r FROM {src} s JOIN {name}_m m ON s.source_id = m.source_id AND s.speaker = m.speaker),
{name}_v AS (SELECT source_id, speaker, medoid_index, count(*) AS n, max(CASE WHEN r = 1 THEN embedding END) AS v1, max(CASE WHEN r = 2 THEN embedding END) AS v2, max(CASE WHEN r = 3 THEN embedding END) AS v3 FROM {name}_r GROUP BY source_id, speaker, medoid_index),
{name}_t AS (SELECT source_id, speaker, medoid_index, n, {self.sum3()} AS total FROM {name}_v),
{name} AS (SELECT source_id, speaker, medoid_index, n, {self.unit('total')} AS proto FROM {name}_t)"""

    def rivals(self, name: str, src: str, protos: str) -> str:
        """best_sp, best, second for each turn of src; of equal prototypes the larger speaker; -1 where there is none."""
        return f"""{name}_k AS (SELECT e.source_id, e.turn_index, p.speaker AS sp, {self.sim('e.embedding', 'p.proto')} AS sim FROM {src} e JOIN {protos} p ON e.source_id = p.source_id AND e.speaker <> p.speaker),
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY source_id, turn_index ORDER BY sim DESC, sp DESC) AS r FROM {name}_k),
{name} AS (SELECT source_id, turn_index, max(CASE WHEN r = 1 THEN sp END) AS best_sp, coalesce(max(CASE WHEN r = 1 THEN sim END), -1.0) AS best, coalesce(max(CASE WHEN r = 2 THEN sim END), -1.0) AS second FROM {name}_o GROUP BY source_id, turn_index)"""

    def pairs(self, name: str, src: str) -> str:
        """Speakers of exactly two turns: their similarity and which of the two is suspect."""
        return f"""{name} AS (SELECT a.source_id, a.speaker, {self.sim('a.embedding', 'b.embedding')} AS pair, CASE WHEN (a.end_ms - a.start_ms) > (b.end_ms - b.start_ms) * 1.35 THEN b.turn_index WHEN (b.end_ms - b.start_ms) > (a.end_ms - a.start_ms) * 1.35 THEN a.turn_index
  WHEN a.start_ms <= b.start_ms THEN b.turn_index ELSE a.turn_index END AS suspect FROM {src} a JOIN {src} b ON a.source_id = b.source_id AND a.speaker = b.speaker AND a.turn_index < b.turn_index
  JOIN (SELECT source_id AS s, speaker AS k FROM {src} GROUP BY source_id, speaker HAVING count(*) = 2) c ON a.source_id = c.s AND a.speaker = c.k)"""

    def stage(self, name: str, src: str, hit: str) -> str:
        """src with the speakers and the marks of candidates that a table of (source_id, turn_index, to_sp, c_stage, c_first) gives."""
        return f"{name} AS (SELECT e.source_id, e.turn_index, e.start_ms, e.end_ms, coalesce(h.to_sp, e.speaker) AS speaker, e.embedding, e.was, e.made, coalesce(e.c_stage, h.c_stage) AS c_stage, CASE WHEN e.c_stage IS NULL THEN h.c_first ELSE e.c_first END AS c_first FROM {src} e LEFT JOIN {hit} h ON e.source_id = h.source_id AND e.turn_index = h.turn_index)"

    def hits(self, turn: int, src: str) -> str:
        """A stage's tables, all from src, and h<turn> (source_id, turn_index, to_sp, c_stage, c_first), what it moves or marks as a
        candidate for a new identity (to_sp null). Prototypes are frozen per stage.

        One: single turns that match another speaker. Two: the suspect of a pair that doesn't agree. Three: outliers of larger
        groups. Four: the suspect of a pair that a rival explains better. c_first: the first turn of a candidate's group."""
        p, r, q, h = (f"{x}{turn}" for x in "prqh")
        size = f"(SELECT source_id AS s, speaker AS k, count(*) AS n, min(turn_index) AS first FROM {src} GROUP BY source_id, speaker)"
        plain = "CAST(NULL AS INT) AS c_stage, CAST(NULL AS BIGINT) AS c_first"
        mark = f"CASE WHEN NOT moves THEN {turn} END AS c_stage, CASE WHEN NOT moves THEN first END AS c_first"
        best = f"JOIN {r} r ON e.source_id = r.source_id AND e.turn_index = r.turn_index"
        parts = [self.prototypes(p, src), self.rivals(r, src, p)]
        if turn in (2, 4):
            parts.append(self.pairs(q, src))
            rule = "pair < 0.35 AND best >= 0.55 AND best - second >= 0.12" if turn == 2 else "pair < 0.50 AND best >= 0.58 AND best - pair >= 0.15 AND best - second >= 0.10"
            if turn == 4:
                parts.append(f"{h} AS (SELECT q.source_id, q.suspect AS turn_index, best_sp AS to_sp, {plain} FROM {q} q JOIN {r} r ON q.source_id = r.source_id AND q.suspect = r.turn_index WHERE best_sp IS NOT NULL AND {rule})")
            else:
                parts.append(f"{q}_m AS (SELECT q.source_id, q.suspect, best_sp, first, e.end_ms - e.start_ms AS dur, coalesce(best, -1.0) AS best, coalesce({rule}, false) AS moves FROM {q} q JOIN {src} e ON q.source_id = e.source_id AND q.suspect = e.turn_index JOIN {size} g ON q.source_id = g.s AND q.speaker = g.k LEFT JOIN {r} r ON q.source_id = r.source_id AND q.suspect = r.turn_index WHERE pair < 0.35)")
                parts.append(f"{h} AS (SELECT source_id, suspect AS turn_index, CASE WHEN moves THEN best_sp END AS to_sp, {mark} FROM {q}_m WHERE moves OR (dur >= {NEW_MS} AND best < 0.45))")
        elif turn == 1:
            parts.append(f"{h} AS (SELECT e.source_id, e.turn_index, best_sp AS to_sp, {plain} FROM {src} e JOIN {size} g ON e.source_id = g.s AND e.speaker = g.k AND g.n = 1 {best} WHERE best_sp IS NOT NULL AND best >= 0.62 AND best - second >= 0.10)")
        else:
            parts.append(f"own3 AS (SELECT e.source_id, e.turn_index, {self.sim('e.embedding', 'p.proto')} AS own FROM {src} e JOIN {p} p ON e.source_id = p.source_id AND e.speaker = p.speaker)")
            rule = "own < 0.50 AND best_sp IS NOT NULL AND best >= 0.55 AND best - greatest(second, own) >= 0.12"
            parts.append(f"{q}_m AS (SELECT e.source_id, e.turn_index, best_sp, first, own, e.end_ms - e.start_ms AS dur, coalesce(best, -1.0) AS best, coalesce({rule}, false) AS moves FROM {src} e JOIN {size} g ON e.source_id = g.s AND e.speaker = g.k AND g.n >= 3 JOIN own3 o ON e.source_id = o.source_id AND e.turn_index = o.turn_index LEFT {best})")
            parts.append(f"{h} AS (SELECT source_id, turn_index, CASE WHEN moves THEN best_sp END AS to_sp, {mark} FROM {q}_m WHERE moves OR (own < 0.35 AND best < 0.45 AND dur >= {NEW_MS}))")
        return ",\n".join(parts)

    def refined(self, last: int) -> str:
        """All stages up to `last` in one text, for DuckDB: candidates one after the other, by recursion. e<last> holds the result."""
        parts = [f"e0 AS (SELECT {_START} FROM turn_embeddings WHERE {_VOICED})"]
        for turn in range(1, last + 1):
            parts += [self.hits(turn, f"e{turn - 1}"), self.stage("moved" if turn == 3 else f"e{turn}", f"e{turn - 1}", f"h{turn}")]
            if turn == 3:
                parts.append(f"""cand AS (SELECT {_CANDIDATE} FROM moved WHERE c_stage IS NOT NULL),
adj AS (SELECT a.source_id, a.k, a.turn_index, a.end_ms - a.start_ms AS dur, list(b.k) FILTER (b.k IS NOT NULL) AS near FROM cand a LEFT JOIN cand b ON a.source_id = b.source_id AND b.k < a.k AND {self.sim('a.embedding', 'b.embedding')} >= 0.55 GROUP BY ALL),
grow AS (SELECT source_id, k, turn_index, dur, [k] AS seeds, k AS lead FROM adj WHERE k = 1
  UNION ALL SELECT a.source_id, a.k, a.turn_index, a.dur, CASE WHEN list_min(list_intersect(seeds, near)) IS NULL THEN list_append(seeds, a.k) ELSE seeds END, coalesce(list_min(list_intersect(seeds, near)), a.k) FROM grow g JOIN adj a ON a.source_id = g.source_id AND a.k = g.k + 1),
tops AS (SELECT source_id, max(speaker) AS top FROM (SELECT source_id, speaker FROM moved UNION ALL SELECT source_id, speaker FROM turn_embeddings WHERE NOT ({_VOICED})) x GROUP BY source_id),
fresh AS (SELECT source_id, lead, (top + row_number() OVER (PARTITION BY source_id ORDER BY lead))::INTEGER AS made FROM (SELECT source_id, lead FROM grow GROUP BY ALL HAVING sum(dur) >= {NEW_MS}) x JOIN tops USING (source_id)),
e3 AS (SELECT e.source_id, e.turn_index, e.start_ms, e.end_ms, coalesce(f.made, e.speaker) AS speaker, e.embedding, e.was, f.made, e.c_stage, e.c_first FROM moved e LEFT JOIN grow g USING (source_id, turn_index) LEFT JOIN fresh f ON f.source_id = g.source_id AND f.lead = g.lead)""")
        return ",\n".join(parts)

    def summary(self) -> str:
        e0 = "e0 AS (SELECT source_id, turn_index, start_ms, end_ms, speaker, embedding, speaker AS was FROM turn_embeddings WHERE end_ms - start_ms >= 800 AND end_ms - start_ms < 18000 AND embedding IS NOT NULL)"
        return ",\n".join((
            e0, self.prototypes("p1", "e0"), self.rivals("r1", "e0", "p1"), self.pairs("q1", "e0"),
            f"own AS (SELECT e.source_id, e.speaker, count(*) AS embedded, min({self.sim('e.embedding', 'p.proto')}) AS own_min, median({self.sim('e.embedding', 'p.proto')}) AS own_median, max(CASE WHEN best >= -0.5 THEN best END) AS rival FROM e0 e JOIN p1 p ON e.source_id = p.source_id AND e.speaker = p.speaker LEFT JOIN r1 r ON e.source_id = r.source_id AND e.turn_index = r.turn_index GROUP BY e.source_id, e.speaker)",
            "gap AS (SELECT *, greatest(0, lead(start_ms) OVER (PARTITION BY source_id, speaker ORDER BY start_ms) - end_ms) AS gap FROM turn_embeddings)",
            "every AS (SELECT source_id AS s, speaker AS k, count(*) AS turns, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, min(start_ms) AS first_start, max(start_ms) AS last_start, CAST(coalesce(max(gap), 0) AS BIGINT) AS max_gap_ms FROM gap GROUP BY source_id, speaker)",
            "facts AS (SELECT s AS source_id, k AS speaker, turns, coalesce(embedded, 0) AS embedded_turns, total_ms, first_start, last_start, max_gap_ms, pair, own_min, own_median, rival FROM every LEFT JOIN own o ON s = o.source_id AND k = o.speaker LEFT JOIN q1 q ON s = q.source_id AND k = q.speaker)",
            """verdict AS (SELECT *, CASE WHEN embedded_turns = 2 AND rival >= 0.58 AND rival - pair >= 0.15 THEN 'rival_mas_probable_que_identidad_actual' WHEN embedded_turns >= 3 AND rival >= 0.62 AND rival - own_min >= 0.15 THEN 'alguna_muestra_cercana_a_identidad_rival' END AS identity_warning,
  CASE WHEN embedded_turns = 0 THEN 'sin_datos' WHEN embedded_turns = 1 THEN 'insuficiente' WHEN embedded_turns = 2 THEN CASE WHEN rival >= 0.58 AND rival - pair >= 0.15 THEN 'baja' WHEN pair >= 0.55 THEN 'alta' WHEN pair >= 0.40 THEN 'media' ELSE 'baja' END
  WHEN rival >= 0.62 AND rival - own_min >= 0.15 THEN 'media' WHEN own_median >= 0.78 THEN 'alta' WHEN own_median >= 0.65 THEN 'media' ELSE 'baja' END AS confidence FROM facts)""",
        ))


def _both(make) -> Query:
    return Query(make(_Dialect(True)), duck_sql=make(_Dialect(False)))


def _sampled(make) -> Query:
    """As _both, from the vectors that identities are made from."""
    return _both(lambda d: make(d).replace("turn_embeddings", "sampled_turns"))


#: Turns of a speaker whose scores one task computes, and rows of them compared at once.
BLOCK, ROWS = 1024, 32


def _scores(table: pa.Table) -> pa.Table:
    """The median cosine of the own turns of a table to all its others; products are added in order and rounded as by sim."""
    size = len(table)
    vectors = table["embedding"].combine_chunks()
    wide = np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False).reshape(size, -1).T)
    turn, own = table["turn_index"].to_numpy(), np.flatnonzero(table["own"].to_numpy())
    scores = []
    for at in range(0, len(own), ROWS):
        some = own[at : at + ROWS]
        sims = np.zeros((len(some), size))
        for x in wide:
            sims += x[some, None] * x
        sims *= 1e9
        sims = np.clip(np.trunc(sims + np.copysign(0.5, sims)) / 1e9, -1.0, 1.0)
        scores += [float(np.median(row[turn != turn[i]])) if size > 1 else None for i, row in zip(some, sims, strict=True)]
    return pa.table({"source_id": table["source_id"].take(own), "speaker": table["speaker"].take(own), "turn_index": table["turn_index"].take(own), "score": pa.array(scores, pa.float64())})


def prototypes(turns: DataFrame) -> DataFrame:
    """As prototypes of _Dialect, of any number of turns (source_id, turn_index, speaker, embedding, not null and of one length).

    All pairs of a speaker's turns count, but none is a row: a task takes BLOCK of them and compares them with all, and gives a score
    each. A speaker's vectors are shipped once for each of their blocks."""
    d, ids = _Dialect(True), ["source_id", "speaker"]
    turns = turns.select(*ids, "turn_index", "embedding")
    sizes = turns.groupBy(*ids).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_of"))
    dealt = turns.join(sizes, ids).select("*", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("_block"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("turn_index"), "_of") == F.col("_block")).drop("_of")
    kinds = turns.schema
    scores = dealt.groupBy(*ids, "_block").applyInArrow(_scores, ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in (*ids, "turn_index")) + ", score double")
    best = scores.groupBy(*ids).agg(F.min(F.struct(-F.round(F.coalesce("score", F.lit(1.0)), 8), "turn_index"))["turn_index"].alias("medoid_index"), F.count("*").alias("n"))
    return over(turns.sparkSession, f"""WITH m AS (SELECT b.source_id, b.speaker, b.medoid_index, n, e.embedding AS medoid FROM best b JOIN src e ON b.source_id = e.source_id AND b.speaker = e.speaker AND b.medoid_index = e.turn_index),
near AS (SELECT * FROM (SELECT s.source_id, s.speaker, s.embedding, medoid_index, n, row_number() OVER (PARTITION BY s.source_id, s.speaker ORDER BY {d.sim('s.embedding', 'medoid')} DESC, s.turn_index) AS r FROM src s JOIN m ON s.source_id = m.source_id AND s.speaker = m.speaker) x WHERE r <= 3),
v AS (SELECT source_id, speaker, medoid_index, n, max(CASE WHEN r = 1 THEN embedding END) AS v1, max(CASE WHEN r = 2 THEN embedding END) AS v2, max(CASE WHEN r = 3 THEN embedding END) AS v3 FROM near GROUP BY source_id, speaker, medoid_index, n),
t AS (SELECT source_id, speaker, medoid_index, n, {d.sum3()} AS total FROM v)
SELECT source_id, speaker, medoid_index, n, {d.unit('total')} AS proto FROM t""", {"best": written(best, "medoids"), "src": turns})


def cluster_candidates(found: DataFrame) -> DataFrame:
    """found (source_id, turn_index, k, start_ms, end_ms, embedding) with lead: k of the first seed that a candidate matches by a
    cosine of 0.55. A candidate is a seed unless an earlier seed matches it; k is 1, 2, ... in a source.

    All sources go on at once: in each round those are decided whose earlier matches are, so that rounds grow with the longest
    chain of matches and not with the candidates of a source."""
    spark, d = found.sparkSession, _Dialect(True)
    found = written(found, "candidates")
    edges = written(over(spark, f"SELECT a.source_id, a.k, b.k AS j FROM found a JOIN found b ON a.source_id = b.source_id AND b.k < a.k WHERE {d.sim('a.embedding', 'b.embedding')} >= 0.55", {"found": found}), "edges")
    state = over(spark, "SELECT f.source_id, f.k, CASE WHEN e.k IS NULL THEN true END AS seed FROM found f LEFT JOIN (SELECT DISTINCT source_id, k FROM edges) e ON f.source_id = e.source_id AND f.k = e.k", {"found": found, "edges": edges})
    while True:
        state = written(state, "seeds")
        if state.where("seed IS NULL").isEmpty():
            break
        state = over(spark, """WITH seen AS (SELECT e.source_id, e.k, max(coalesce(s.seed, false)) AS hit, max(s.seed IS NULL) AS waits FROM edges e JOIN state s ON e.source_id = s.source_id AND e.j = s.k GROUP BY e.source_id, e.k)
SELECT s.source_id, s.k, CASE WHEN s.seed IS NOT NULL THEN s.seed WHEN hit THEN false WHEN NOT waits THEN true END AS seed FROM state s LEFT JOIN seen n ON s.source_id = n.source_id AND s.k = n.k""", {"edges": edges, "state": state})
    return over(spark, """WITH led AS (SELECT e.source_id, e.k, min(e.j) AS lead FROM edges e JOIN state s ON e.source_id = s.source_id AND e.j = s.k AND s.seed GROUP BY e.source_id, e.k)
SELECT f.*, coalesce(l.lead, f.k) AS lead FROM found f LEFT JOIN led l ON f.source_id = l.source_id AND f.k = l.k""", {"found": found, "edges": edges, "state": state})


def _new_identities(now: DataFrame, rest: DataFrame) -> DataFrame:
    """Candidates that agree, and speak for 2.5 s together, get numbers after the last speaker of their source, in their order."""
    spark = now.sparkSession
    cand = over(spark, f"SELECT {_CANDIDATE} FROM now WHERE c_stage IS NOT NULL", {"now": now})
    if cand.isEmpty():
        return now
    tables = {"now": now, "rest": rest, "grown": written(cluster_candidates(cand), "grown")}
    return over(spark, f"""WITH tops AS (SELECT source_id, max(speaker) AS top FROM (SELECT source_id, speaker FROM now UNION ALL SELECT source_id, speaker FROM rest) x GROUP BY source_id),
kept AS (SELECT source_id, lead, row_number() OVER (PARTITION BY source_id ORDER BY lead) AS place FROM grown GROUP BY source_id, lead HAVING sum(end_ms - start_ms) >= {NEW_MS}),
fresh AS (SELECT g.source_id, g.turn_index, CAST(top + place AS INT) AS id FROM grown g JOIN kept k ON g.source_id = k.source_id AND g.lead = k.lead JOIN tops t ON g.source_id = t.source_id)
SELECT n.source_id, n.turn_index, n.start_ms, n.end_ms, coalesce(f.id, n.speaker) AS speaker, n.embedding, n.was, f.id AS made, n.c_stage, n.c_first FROM now n LEFT JOIN fresh f ON n.source_id = f.source_id AND n.turn_index = f.turn_index""", tables)


def refine(turns: DataFrame, last: int = 4) -> DataFrame:
    """turns (source_id, turn_index, start_ms, end_ms, speaker int, embedding) with speakers refined by stages one to `last`; was,
    the speaker before, and made, the number of a new identity (made after stage three, from turns that no speaker explains).

    Turns without a vector, under 0.8 s or of 18 s and more stay as they are. Each stage is written, as the next reads it many times."""
    d, spark = _Dialect(True), turns.sparkSession
    voiced = f"coalesce({_VOICED}, false)"
    rest = over(spark, f"SELECT {_START} FROM turns WHERE NOT {voiced}", {"turns": turns})
    now = over(spark, f"SELECT {_START} FROM turns WHERE {voiced}", {"turns": turns})
    for turn in range(1, last + 1):
        now = written(now, "turns")
        now = over(spark, f"WITH {d.hits(turn, 'held')}, {d.stage('moved', 'held', f'h{turn}')} SELECT * FROM moved", {"held": now})
        if turn == 3:
            now = _new_identities(written(now, "turns"), rest)
    return now.unionByName(rest).drop("c_stage", "c_first")


def refine_identities(spark, sf_dir):
    found = refine(views.sampled_turns(spark, sf_dir), 3)
    return found.selectExpr("source_id", "turn_index", "was AS from_speaker", "speaker AS to_speaker", "was <> speaker AS reassigned", "made AS new_identity")


def refine_identities_v52(spark, sf_dir):
    found = refine(views.sampled_turns(spark, sf_dir), 4)
    return over(spark, f"SELECT {_RECOUNT} FROM found GROUP BY source_id", {"found": found})


_RECOUNT = "source_id, count(DISTINCT was) AS speakers_before, count(DISTINCT speaker) AS speakers_after, CAST(sum(CASE WHEN was <> speaker THEN 1 ELSE 0 END) AS BIGINT) AS reassigned_turns, count(DISTINCT made) AS new_identities"
#: What DuckDB adds to the refined turns: those that aren't refined.
_REST = f"SELECT source_id, turn_index, speaker AS was, speaker, NULL::INTEGER AS made FROM turn_embeddings WHERE NOT ({_VOICED})"


def _sampling(per_speaker: int, total: int) -> str:
    """picked (source_id, turn_index, speaker): the first and last eligible turn of a speaker and the longest, `per_speaker` of them, and of these the `total` longest of a source. Reads turn_embeddings."""
    return f"""{_E0}, o AS (SELECT source_id, turn_index, speaker, end_ms - start_ms AS d, row_number() OVER (PARTITION BY source_id, speaker ORDER BY start_ms) AS f, row_number() OVER (PARTITION BY source_id, speaker ORDER BY start_ms DESC) AS l, row_number() OVER (PARTITION BY source_id, speaker ORDER BY end_ms - start_ms DESC, turn_index) AS g FROM e0),
c AS (SELECT *, row_number() OVER (PARTITION BY source_id, speaker ORDER BY CASE WHEN f = 1 THEN 0 WHEN l = 1 THEN 1 ELSE 2 END, g) AS pick FROM o),
picked AS (SELECT source_id, turn_index, speaker FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY d DESC, speaker, turn_index) AS place FROM c WHERE pick <= {per_speaker}) t WHERE place <= {total})"""


_EXTRACTED = """extracted AS (SELECT t.source_id, CAST(sum(CASE WHEN kind = 'eligible' THEN 1 ELSE 0 END) AS BIGINT) AS eligible, count(p.turn_index) AS selected, count(p.turn_index) AS attempted, count(CASE WHEN p.turn_index IS NOT NULL THEN embedding END) AS computed,
  CAST(sum(CASE WHEN kind = 'short' THEN 1 ELSE 0 END) AS BIGINT) AS skipped_short, CAST(sum(CASE WHEN kind = 'long' THEN 1 ELSE 0 END) AS BIGINT) AS skipped_long, sum(CASE WHEN kind = 'eligible' THEN 1 ELSE 0 END) > count(p.turn_index) AS capped
  FROM (SELECT *, CASE WHEN end_ms - start_ms < 800 THEN 'short' WHEN end_ms - start_ms >= 18000 THEN 'long' ELSE 'eligible' END AS kind FROM turn_embeddings) t LEFT JOIN picked p ON t.source_id = p.source_id AND t.turn_index = p.turn_index GROUP BY t.source_id)"""


def light_identity(turns: DataFrame, audio: DataFrame, per_speaker: int = 3, total: int = 18) -> tuple[DataFrame, DataFrame]:
    """A cheap look at the identities of turns (as for refine): the refined turns, and a row a source of what was sampled, how the
    speakers look and what is wrong with them. audio: source_id, end_ms. Only `total` vectors of a source are used."""
    from turnwise.operators.structure import STRUCTURE

    spark = turns.sparkSession
    turns = written(turns, "turns")
    tables = {"turn_embeddings": turns}
    picked = written(over(spark, f"WITH {_sampling(per_speaker, total)} SELECT * FROM picked", tables), "picked")
    extracted = over(spark, f"WITH {_EXTRACTED} SELECT * FROM extracted", {**tables, "picked": picked})
    heard = turns.join(picked.select("source_id", "turn_index", F.lit(True).alias("_picked")), ["source_id", "turn_index"], "left").withColumn("embedding", F.when(F.col("_picked"), F.col("embedding"))).drop("_picked")
    refined = written(refine(heard), "refined")
    looks = over(spark, f"WITH {STRUCTURE} SELECT source_id, speaker_count, turn_count, round(penalty, 6) AS penalty FROM scored", {"turns": refined.withColumnRenamed("speaker", "raw_speaker"), "segments": audio})
    doubts = over(spark, f"WITH {_Dialect(True).summary()}, {_OVERALL} SELECT source_id, overall_confidence, low, penalty AS identity_penalty FROM overall", {"turn_embeddings": refined})
    moved = over(spark, f"SELECT {_RECOUNT} FROM found GROUP BY source_id", {"found": refined})
    row = extracted
    for other in (moved, looks, doubts):
        row = row.join(other, "source_id", "left")
    return refined, row


def light_identity_query(spark, sf_dir):
    turns = views.turn_embeddings(spark, sf_dir)
    return light_identity(turns, turns.select("source_id", "end_ms"))[1]


def scan_candidates(turns: DataFrame, most: int = 4, least_ms: int = 18_000) -> DataFrame:
    """source_id, turn_index, place: the longest turns of a source, of 18 s at least, that others overlap by 15 % at most."""
    from turnwise.operators.intervals import overlap_ratio

    ratio = overlap_ratio(turns).where("overlap_ratio <= 0.15").select("source_id", "turn_index")
    order = Window.partitionBy("source_id").orderBy(F.desc(F.col("end_ms") - F.col("start_ms")), "turn_index")
    found = turns.where(F.col("end_ms") - F.col("start_ms") >= least_ms).join(ratio, ["source_id", "turn_index"], "left_semi")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("source_id", "turn_index", "place")


def scan_candidates_query(spark, sf_dir):
    """Every fifth embedded turn starts 5 s before the end of the one before it, so that some overlap; of the transcripts' turns too."""
    e = views.turn_embeddings(spark, sf_dir)
    early = F.when(F.col("turn_index") % 5 == 4, F.greatest(F.lit(0), F.col("start_ms") - 5000)).otherwise(F.col("start_ms"))
    own = e.select("source_id", "turn_index", early.cast("long").alias("start_ms"), "end_ms", F.col("speaker").alias("raw_speaker"))
    return scan_candidates(own)


SCAN_ORACLE = """WITH t AS (SELECT source_id, turn_index, CASE WHEN turn_index % 5 = 4 THEN greatest(0, start_ms - 5000) ELSE start_ms END AS a, end_ms AS b, speaker FROM turn_embeddings),
o AS (SELECT x.source_id, x.turn_index, x.b - x.a AS d, coalesce(sum(least(x.b, y.b) - greatest(x.a, y.a)) FILTER (y.source_id IS NOT NULL), 0) AS o FROM t x LEFT JOIN t y ON x.source_id = y.source_id AND x.speaker <> y.speaker AND y.a < x.b AND y.b > x.a WHERE x.b - x.a >= 18000 GROUP BY ALL)
SELECT source_id, turn_index, place FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY d DESC, turn_index)::INTEGER AS place FROM o WHERE round(least(1, o / d), 6) <= 0.15) WHERE place <= 4"""

OWN = {
    "scan_candidates": (scan_candidates_query, SCAN_ORACLE),
    "refine_identities": (refine_identities, f"WITH RECURSIVE {_Dialect(False).refined(3)}, every AS (SELECT source_id, turn_index, was, speaker, made FROM e3 UNION ALL {_REST}) SELECT source_id, turn_index, was AS from_speaker, speaker AS to_speaker, was <> speaker AS reassigned, made AS new_identity FROM every".replace("turn_embeddings", "sampled_turns")),
    "refine_identities_v52": (refine_identities_v52, f"WITH RECURSIVE {_Dialect(False).refined(4)}, every AS (SELECT source_id, turn_index, was, speaker, made FROM e4 UNION ALL {_REST}) SELECT {_RECOUNT} FROM every GROUP BY source_id".replace("turn_embeddings", "sampled_turns")),
    "light_identity": (light_identity_query, None),
}
QUERIES = {
    "vec_normalize": Query("""WITH v AS (SELECT vec_id, transform(embedding, x -> CAST(x AS DOUBLE) * (vec_id % 5)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(aggregate(v, CAST(0 AS DOUBLE), (s, x) -> s + x * x)) AS norm FROM v)
SELECT vec_id, round(norm, 6) AS norm, CASE WHEN norm > 0 AND norm < double('Infinity') THEN array_join(transform(slice(v, 1, 3), x -> CAST(CAST(round(x / norm * 10000) AS BIGINT) AS STRING)), ',') END AS unit FROM n""",
        duck_sql="""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 5)) AS v FROM embeddings)
SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, CASE WHEN vec_id % 5 > 0 THEN array_to_string(list_transform(v[1:3], lambda x: round(x / sqrt(list_inner_product(v, v)) * 10000)::BIGINT), ',') END AS unit FROM v"""),
    "pair_similarity": _sampled(lambda d: f"WITH {_E0}, {d.pairs('q', 'e0')} SELECT source_id, speaker, round(pair, 6) AS pair, suspect FROM q"),
    "prototypes": _sampled(lambda d: f"WITH {_E0}, {d.prototypes('p', 'e0')} SELECT source_id, speaker, medoid_index, n, round({d.at('proto', 0)}, 6) AS p0, round({d.at('proto', 1)}, 6) AS p1 FROM p"),
    "rival_search": _sampled(lambda d: f"WITH {_E0}, {d.prototypes('p', 'e0')}, {d.rivals('r', 'e0', 'p')} SELECT source_id, turn_index, best_sp, round(best, 6) AS best, round(second, 6) AS second FROM r"),
    "identity_summary": _sampled(lambda d: f"WITH {d.summary()} SELECT source_id, speaker, turns, embedded_turns, total_ms, first_start, last_start, max_gap_ms, round(pair, 6) AS pair_similarity, round(own_min, 6) AS prototype_similarity_min, round(own_median, 6) AS prototype_similarity_median, round(rival, 6) AS rival_similarity_max, confidence, identity_warning, total_ms < 3000 AS brief_identity FROM verdict"),
    "identity_overall": _sampled(lambda d: f"WITH {d.summary()}, {_OVERALL} SELECT * FROM overall"),
    "embedding_eligibility": Query("SELECT source_id, turn_index, CASE WHEN end_ms - start_ms < 800 THEN 'short' WHEN end_ms - start_ms >= 18000 THEN 'long' ELSE 'eligible' END AS kind FROM turn_embeddings"),
    "embedding_sampling": Query(f"WITH {_sampling(8, 64)} SELECT * FROM picked"),
    "extraction_summary": Query(f"WITH {_sampling(8, 64)}, {_EXTRACTED} SELECT * FROM extracted",
        duck_sql=f"""WITH {_sampling(8, 64)}, n AS (SELECT source_id, count(*) AS selected FROM picked GROUP BY 1)
SELECT t.source_id, count(*) FILTER (end_ms - start_ms BETWEEN 800 AND 17999) AS eligible, any_value(selected) AS selected, any_value(selected) AS attempted, any_value(selected) AS computed, count(*) FILTER (end_ms - start_ms < 800) AS skipped_short, count(*) FILTER (end_ms - start_ms >= 18000) AS skipped_long, eligible > any_value(selected) AS capped FROM turn_embeddings t JOIN n ON t.source_id = n.source_id GROUP BY 1"""),
    # Intervals are asked for once by the precheck (turns under 18 s) and once by the last pass (all turns); keys are bounds in ms.
    "embedding_cache_stats": Query("""WITH asks AS (SELECT source_id, start_ms, end_ms FROM turn_embeddings WHERE end_ms - start_ms < 18000 UNION ALL SELECT source_id, start_ms, end_ms FROM turn_embeddings),
k AS (SELECT source_id, start_ms, end_ms, count(*) AS n FROM asks GROUP BY source_id, start_ms, end_ms)
SELECT source_id, CAST(sum(n) AS BIGINT) AS asked, CAST(sum(n - 1) AS BIGINT) AS cache_hits, CAST(sum(CASE WHEN end_ms - start_ms >= 800 THEN 1 ELSE 0 END) AS BIGINT) AS embedding_calls FROM k GROUP BY source_id""",
        duck_sql="SELECT source_id, count(*) + count(*) FILTER (end_ms - start_ms < 18000) AS asked, count(*) FILTER (end_ms - start_ms < 18000) AS cache_hits, count(*) FILTER (end_ms - start_ms >= 800) AS embedding_calls FROM turn_embeddings GROUP BY source_id"),
    "long_turn_probe": _both(lambda d: f"""WITH {_E0.replace('turn_embeddings', 'sampled_turns')}, {d.prototypes('p', 'e0')}, l AS (SELECT source_id, turn_index, speaker FROM turn_embeddings WHERE end_ms - start_ms >= 18000),
w AS (SELECT l.source_id, l.turn_index, l.speaker, e.turn_index AS w_index, e.embedding FROM l JOIN turn_embeddings e ON l.source_id = e.source_id AND e.turn_index >= l.turn_index AND e.turn_index < l.turn_index + 3),
c AS (SELECT w.source_id, w.turn_index, count(*) AS windows, min({d.sim('w.embedding', 'p.proto')}) AS lowest, count(p.speaker) AS sims FROM w LEFT JOIN p ON w.source_id = p.source_id AND w.speaker = p.speaker GROUP BY w.source_id, w.turn_index),
m AS (SELECT a.source_id, a.turn_index, median({d.sim('a.embedding', 'b.embedding')}) AS mutual FROM w a JOIN w b ON a.source_id = b.source_id AND a.turn_index = b.turn_index AND a.w_index < b.w_index GROUP BY a.source_id, a.turn_index)
SELECT c.source_id, c.turn_index, windows, coalesce(windows >= 2 AND ((sims >= 2 AND lowest >= 0.58) OR mutual >= 0.62), false) AS homogeneous FROM c LEFT JOIN m ON c.source_id = m.source_id AND c.turn_index = m.turn_index"""),
}
