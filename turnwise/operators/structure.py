"""Structure of turns, penalties and the decisions that rest on them."""

from __future__ import annotations

import re

from turnwise.operators.intervals import MERGE, MERGE_DUCK
from turnwise.plans.query import Query

#: Speakers, seconds and switches of the merged turns of a source, and the penalty for what looks wrong.
STRUCTURE = MERGE.format(gap=550) + """,
audio AS (SELECT source_id AS a_id, max(end_ms) / 1000.0 AS audio_s FROM segments GROUP BY source_id),
per AS (SELECT source_id, raw_speaker, sum(end_ms - start_ms) / 1000.0 AS secs, max(end_ms - start_ms) / 1000.0 AS longest, count(*) AS n FROM merged GROUP BY source_id, raw_speaker),
share AS (SELECT *, secs / sum(secs) OVER (PARTITION BY source_id) AS share FROM per),
base AS (SELECT source_id, count(*) AS speaker_count, CAST(sum(n) AS BIGINT) AS turn_count, sum(secs) AS speech, max(share) AS dominant, max(longest) AS longest,
  CAST(sum(CASE WHEN secs < 3.0 OR share < 0.02 THEN 1 ELSE 0 END) AS BIGINT) AS tiny, max(audio_s) AS audio_s FROM share JOIN audio ON source_id = a_id GROUP BY source_id),
structure AS (SELECT *, greatest(0, turn_count - 1) / greatest(audio_s / 60.0, speech / 60.0, 1 / 60.0) AS switches FROM base),
scored AS (SELECT *, CASE WHEN speaker_count <= 1 THEN 8.0 WHEN speaker_count > 8 THEN 2.0 * (speaker_count - 8) ELSE 0.0 END + greatest(0.0, dominant - 0.65) * 4.0 + greatest(0.0, longest - 60.0) / 60.0
  + tiny * 0.8 + greatest(0.0, switches - 16.0) / 8.0 + CASE WHEN speaker_count = 2 AND dominant >= 0.80 THEN 1.0 ELSE 0.0 END AS penalty FROM structure)"""

_RETRY = """CASE WHEN speaker_count <= 1 THEN 'subdeteccion_extrema' WHEN speaker_count > 8 THEN 'sobredeteccion_extrema' WHEN tiny >= 2 OR switches > 18.0 THEN 'fragmentacion_excesiva'
  WHEN speaker_count <= 4 AND (longest >= 60.0 OR (longest >= 45.0 AND dominant >= 0.55)) THEN 'tramo_monopolizado' WHEN speaker_count <= 4 AND dominant >= 0.72 THEN 'hablante_dominante' END"""


def _second(text: str) -> str:
    """The same of a second pass, which hears only turns of 1.5 s and more: tables that end in _b."""
    text = text.replace("FROM turns WHERE end_ms > start_ms", "FROM turns WHERE end_ms - start_ms >= 1500")
    for name in ("run", "cut", "isle", "merged", "audio", "per", "share", "base", "structure", "scored"):
        text = re.sub(rf"\b(FROM |JOIN ){name}\b|(?m:^|, ){name} AS \(", lambda m: m[0].replace(name, name + "_b", 1), text)
    return text


STRUCTURE_B = _second(STRUCTURE)

#: What the queries below read: the same in whole milliseconds, as DuckDB's text has it, so that shares and sums that lie on a bound
#: don't depend on the order in which doubles are added. The penalty is added in the order of that text.
EXACT = MERGE.format(gap=550) + """,
audio AS (SELECT source_id AS a_id, max(end_ms) AS audio_ms FROM segments GROUP BY source_id),
per AS (SELECT source_id, raw_speaker, sum(end_ms - start_ms) AS ms, max(end_ms - start_ms) AS top, count(*) AS n FROM merged GROUP BY source_id, raw_speaker),
share AS (SELECT *, sum(ms) OVER (PARTITION BY source_id) AS all_ms FROM per),
base AS (SELECT source_id, count(*) AS speaker_count, CAST(sum(n) AS BIGINT) AS turn_count, max(all_ms) AS speech_ms, max(ms) AS most_ms, max(top) AS top_ms,
  CAST(sum(CASE WHEN ms < 3000 OR 50 * ms < all_ms THEN 1 ELSE 0 END) AS BIGINT) AS tiny, max(audio_ms) AS audio_ms FROM share JOIN audio ON source_id = a_id GROUP BY source_id),
structure AS (SELECT *, CAST((turn_count - 1) * 60000 AS DOUBLE) / greatest(audio_ms, speech_ms, 1000) AS switches, CAST(most_ms AS DOUBLE) / speech_ms AS dominant, CAST(top_ms AS DOUBLE) / 1000 AS longest FROM base),
scored AS (SELECT *, CASE WHEN speaker_count = 1 THEN 8.0 ELSE 0.0 END + 2.0 * greatest(0, speaker_count - 8) + 4.0 * greatest(0.0, dominant - 0.65) + greatest(0.0, longest / 60.0 - 1.0)
  + tiny * 0.8 + greatest(0.0, switches / 8.0 - 2.0) + CASE WHEN speaker_count = 2 AND dominant >= 0.8 THEN 1.0 ELSE 0.0 END AS penalty FROM structure)"""
_OF_A = re.sub(r"\b(speaker_count|tiny|switches|longest|dominant)\b(?=[ )])", r"a.\1", _RETRY)
_PAIRS = f"""{_second(EXACT)}, pairs AS (SELECT a.source_id, a.speaker_count AS n_a, a.penalty AS p_a, coalesce(b.speaker_count, 0) AS n_b, coalesce(b.penalty, 8.0) + 0.25 * greatest(0, abs(coalesce(b.speaker_count, 0) - a.speaker_count) - 2) AS p_b, {_OF_A} AS reason FROM scored a LEFT JOIN scored_b b ON a.source_id = b.source_id)"""


def _six(value: str) -> str:
    """value to six places as DuckDB rounds: the product with a million, halves away from zero. Spark's own rounding reads the
    shortest decimal, which lies on the other side of a half now and then."""
    return f"round({value} * 1000000.0) / 1000000.0"


def _scored_duck(turns: str) -> str:
    """The structure and penalty of the turns of a source, for DuckDB: whole milliseconds, turns gone through in order."""
    return MERGE_DUCK.format(gap=550, turns=turns) + """,
per AS (SELECT source_id, raw_speaker, sum(end_ms - start_ms) AS ms, max(end_ms - start_ms) AS top, count(*) AS n FROM merged GROUP BY ALL),
whole AS (SELECT source_id, count(*) AS speakers, sum(n)::BIGINT AS turns, sum(ms) AS speech_ms, max(ms) AS most_ms, max(top) AS top_ms, list(ms) AS each FROM per GROUP BY ALL),
facts AS (SELECT w.*, len(list_filter(each, lambda x: x < 3000 OR 50 * x < speech_ms)) AS tiny, (turns - 1) * 60000::DOUBLE / greatest(audio_ms, speech_ms, 1000) AS switches, most_ms::DOUBLE / speech_ms AS share, top_ms / 1000::DOUBLE AS top_s
  FROM whole w JOIN (SELECT source_id, max(end_ms) AS audio_ms FROM segments GROUP BY ALL) USING (source_id)),
scored AS (SELECT *, list_sum([if(speakers = 1, 8, 0), 2 * greatest(0, speakers - 8), 4 * greatest(0, share - 0.65::DOUBLE), greatest(0, top_s / 60 - 1), tiny * 0.8::DOUBLE, greatest(0, switches / 8 - 2), if(speakers = 2 AND share >= 0.8::DOUBLE, 1, 0)]::DOUBLE[]) AS penalty,
  list_filter([{'c': speakers = 1, 'r': 'subdeteccion_extrema', 't': 0.68}, {'c': speakers > 8, 'r': 'sobredeteccion_extrema', 't': 0.82}, {'c': tiny >= 2 OR switches > 18, 'r': 'fragmentacion_excesiva', 't': 0.82},
    {'c': speakers <= 4 AND (top_ms >= 60000 OR (top_ms >= 45000 AND share >= 0.55::DOUBLE)), 'r': 'tramo_monopolizado', 't': 0.68}, {'c': speakers <= 4 AND share >= 0.72::DOUBLE, 'r': 'hablante_dominante', 't': 0.68}], lambda x: x.c)[1] AS retry FROM facts)"""


#: The profile of a job is what its last event stands for; its budget is a share of the audio's length less the time of the
#: transcription and a reserve of 5 s.
_BUDGET = """last AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
b AS (SELECT m.*, CASE event_type WHEN 'click' THEN 'Rápido' WHEN 'view' THEN 'Equilibrado' WHEN 'purchase' THEN 'Preciso' ELSE 'Personalizado' END AS profile, CASE event_type WHEN 'click' THEN 85 WHEN 'view' THEN 100 WHEN 'purchase' THEN 150 END AS ratio FROM job_metrics m JOIN last ON job_id = user_id AND r = 1),
c AS (SELECT *, CASE WHEN ratio IS NOT NULL THEN greatest(0, CAST(floor(audio_cs * ratio / 100.0) AS BIGINT) - asr_cs - 500) END AS budget_cs FROM b)"""
_BUDGET_DUCK = """w AS (SELECT user_id AS job_id, MAP {'click': 'Rápido', 'view': 'Equilibrado', 'purchase': 'Preciso'}[arg_max(event_type, (ts, event_id))] AS p FROM events GROUP BY 1),
c AS (SELECT *, coalesce(p, 'Personalizado') AS profile, CASE WHEN p IS NOT NULL THEN greatest(0, audio_cs * MAP {'Rápido': 85, 'Equilibrado': 100, 'Preciso': 150}[p] // 100 - asr_cs - 500)::BIGINT END AS budget_cs FROM job_metrics JOIN w USING (job_id))"""

QUERIES = {
    "turn_structure": Query(f"WITH {EXACT} SELECT source_id, speaker_count, turn_count, {_six('(CAST(speech_ms AS DOUBLE) / 1000)')} AS speech_seconds, {_six('dominant')} AS dominant_share, {_six('longest')} AS longest_turn_seconds, tiny AS tiny_speakers, {_six('switches')} AS switches_per_minute, {_six('penalty')} AS penalty FROM scored",
        duck_sql=f"WITH {_scored_duck('turns')} SELECT source_id, speakers AS speaker_count, turns AS turn_count, round(speech_ms / 1000, 6) AS speech_seconds, round(share, 6) AS dominant_share, round(top_s, 6) AS longest_turn_seconds, tiny AS tiny_speakers, round(switches, 6) AS switches_per_minute, round(penalty, 6) AS penalty FROM scored"),
    "retry_decision": Query(f"WITH {EXACT}, r AS (SELECT source_id, {_RETRY} AS reason FROM scored) SELECT source_id, reason, CASE WHEN reason IN ('sobredeteccion_extrema', 'fragmentacion_excesiva') THEN CAST(0.82 AS DOUBLE) WHEN reason IS NOT NULL THEN CAST(0.68 AS DOUBLE) END AS threshold FROM r",
        duck_sql=f"WITH {_scored_duck('turns')} SELECT source_id, retry.r AS reason, retry.t::DOUBLE AS threshold FROM scored"),
    "retry_decision_v3": Query(f"WITH {EXACT} SELECT source_id, CASE WHEN speaker_count <= 1 THEN 66 WHEN speaker_count > 8 THEN 84 END AS threshold_hundredths FROM scored",
        duck_sql="SELECT source_id, MAP {1: 66, 9: 84}[least(9, count(DISTINCT raw_speaker))] AS threshold_hundredths FROM turns WHERE end_ms > start_ms GROUP BY source_id"),
    "candidate_selection": Query(f"""WITH {EXACT}, {_PAIRS}
SELECT source_id, n_a, n_b, {_six('p_a')} AS p_a, {_six('p_b')} AS p_b, reason, CASE WHEN reason IN ('subdeteccion_extrema', 'sobredeteccion_extrema') THEN n_b >= 2 AND n_b <= 8 AND p_b - p_a <= 0.5 ELSE p_a - p_b > 0.1 END AS second_wins FROM pairs""",
        duck_sql=f"""WITH one AS (WITH {_scored_duck('turns')} SELECT * FROM scored), two AS (WITH {_scored_duck('(SELECT * FROM turns WHERE end_ms - start_ms >= 1500)')} SELECT * FROM scored),
pairs AS (SELECT a.source_id, a.speakers AS n_a, coalesce(b.speakers, 0) AS n_b, a.penalty AS p_a, coalesce(b.penalty, 8) + 0.25::DOUBLE * greatest(0, abs(coalesce(b.speakers, 0) - a.speakers) - 2) AS p_b, a.retry.r AS reason FROM one a LEFT JOIN two b ON a.source_id = b.source_id)
SELECT source_id, n_a, n_b, round(p_a, 6) AS p_a, round(p_b, 6) AS p_b, reason, if(contains(coalesce(reason, ''), 'extrema'), n_b BETWEEN 2 AND 8 AND p_b - p_a <= 0.5::DOUBLE, p_a - p_b > 0.1::DOUBLE) AS second_wins FROM pairs"""),
    "diarization_budget": Query(f"WITH {_BUDGET} SELECT job_id, profile, budget_cs FROM c", duck_sql=f"WITH {_BUDGET_DUCK} SELECT job_id, profile, budget_cs FROM c"),
    # What the job has taken (loading the model, the first look) and a second pass as long as the first, against the budget.
    "budget_skip": Query(f"WITH {_BUDGET} SELECT job_id, budget_cs, CASE WHEN budget_cs IS NOT NULL THEN model_load_cs + overhead_cs + diarization_cs END AS projected_cs, coalesce(model_load_cs + overhead_cs + diarization_cs > budget_cs, false) AS skip FROM c",
        duck_sql=f"WITH {_BUDGET_DUCK}, d AS (SELECT *, model_load_cs + overhead_cs + diarization_cs AS all_cs FROM c) SELECT job_id, budget_cs, CASE WHEN p IS NOT NULL THEN all_cs END AS projected_cs, p IS NOT NULL AND all_cs - budget_cs > 0 AS skip FROM d"),
}
