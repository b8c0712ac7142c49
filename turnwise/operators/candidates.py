"""Which of two passes of a job is kept: the first look, the budget, the choice by structure and by identities, and what was chosen.

A pass is a table of turns (source_id, turn_index, start_ms, end_ms, speaker, embedding). Both passes of all sources go through one
light look at their identities, under keys of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.operators.identity import _OVERALL, _VOICED, _Dialect, _sampling, light_identity
from turnwise.operators.structure import _RETRY, STRUCTURE
from turnwise.operators.validation import validated
from turnwise.plans.query import over
from turnwise.plans.shared import written
from turnwise.sources import views

#: Thresholds of the first pass and, by reason, of the second; limits of the rules.
FIRST_THRESHOLD, FEWER_THRESHOLD, MORE_THRESHOLD = 0.74, 0.82, 0.68
MAX_SPEAKERS, PRECHECK_PENALTY, IDENTITY_PENALTY, CLOSE, DEAD_BAND = 8, 2.60, 2.0, 1.0, 0.15
FRAGMENTED = ("sobredeteccion_extrema", "fragmentacion_excesiva")
EXTREME = ("subdeteccion_extrema", "sobredeteccion_extrema")
SECOND_REASONS = ("segunda_pasada_mejora_estructura", "seleccion_identity_aware_second")
FIRST_REASONS = ("se_conserva_primera_pasada", "primera_pasada_estable", "precheck_identidad_evito_segunda_pasada", "presupuesto_tiempo_omite_segunda_pasada", "seleccion_identity_aware_first")
#: The share of the audio's length that a profile may take, in percent; a profile without one sets no budget.
RATIOS = {"Rápido": 85, "Equilibrado": 100, "Preciso": 150}
RESERVE_CS = 500


def raw_candidate(meta: DataFrame) -> DataFrame:
    """meta with candidate (first or second), index, speaker_count and threshold: which pass the chosen solution comes from.

    meta: candidates (array of structs threshold, analysis), identity_aware_selection (struct with selected_candidate), retry_avoided,
    selection_reason, retry, selected_threshold. The choice by identities decides, then an avoided second pass, then the
    reason, then a chosen threshold that is the second's to 1e-9; else it is the first. Nulls decide nothing; a pass that isn't
    there has 0 speakers and no threshold."""
    aware = F.col("identity_aware_selection")["selected_candidate"]
    second = F.get("candidates", F.lit(1))
    near = F.coalesce(F.col("retry"), F.lit(False)) & (F.size("candidates") > 1) & (F.abs(F.col("selected_threshold") - second["threshold"]) < 1e-9)
    chosen = (
        F.when(aware.isin("first", "second"), aware).when(F.coalesce("retry_avoided", F.lit(False)), "first").when(F.col("selection_reason").isin(*SECOND_REASONS), "second")
        .when(F.col("selection_reason").isin(*FIRST_REASONS), "first").when(near, "second").otherwise("first")
    )
    out = meta.withColumn("candidate", chosen).withColumn("index", F.when(F.col("candidate") == "second", 1).otherwise(0))
    own = F.get("candidates", F.col("index"))
    return out.withColumn("speaker_count", F.coalesce(own["analysis"]["speaker_count"], F.lit(0)).cast("long")).withColumn("threshold", own["threshold"])


def budget_skip(jobs: DataFrame) -> DataFrame:
    """jobs (budget_s, elapsed_s, precheck_s, first_pass_s) with projected_s and skip: a second pass as long as the first would end
    beyond the budget. Without a budget nothing is skipped; negative and null times count as 0."""
    part = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))
    projected = F.when(F.col("budget_s").isNotNull(), part("elapsed_s") + part("precheck_s") + part("first_pass_s"))
    return jobs.withColumn("projected_s", projected).withColumn("skip", F.coalesce(F.col("projected_s") > F.greatest(F.col("budget_s"), F.lit(0.0)), F.lit(False)))


def precheck(jobs: DataFrame) -> DataFrame:
    """jobs (reason, speakers_before, speakers_after, look_penalty, low, skip) with applies, accepted and skipped: whether a light look
    at the identities of the first pass has settled what made a second one due, or the budget rules it out."""
    applies = F.coalesce(F.col("reason").isin(*FRAGMENTED), F.lit(False))
    settled = F.col("speakers_after").between(2, MAX_SPEAKERS) & (F.col("speakers_after") < F.col("speakers_before")) & (F.coalesce("look_penalty", F.lit(0.0)) <= PRECHECK_PENALTY) & (F.coalesce("low", F.lit(0)) == 0)
    out = jobs.withColumn("applies", applies).withColumn("accepted", F.col("applies") & F.coalesce(settled, F.lit(False)))
    return out.withColumn("skipped", F.col("applies") & ~F.col("accepted") & F.coalesce("skip", F.lit(False)))


def choose(pairs: DataFrame) -> DataFrame:
    """pairs (reason, n_a, p_a, n_b, p_b, s_a, s_b) with structural, needed, aware and which.

    n, p: speakers and penalty of the passes; s: their scores with the identities' penalty, null where there is no look. The
    structure decides, with 0.25 for each speaker by which the passes differ beyond two; where that is not enough the scores do,
    unless they lie within the dead band."""
    adjusted = F.col("p_b") + F.greatest(F.lit(0), F.abs(F.col("n_b") - F.col("n_a")) - 2) * 0.25
    extreme = F.coalesce(F.col("reason").isin(*EXTREME), F.lit(False))
    better = F.when(extreme, F.col("n_b").between(2, MAX_SPEAKERS) & (adjusted <= F.col("p_a") + 0.5)).otherwise(adjusted + 0.1 < F.col("p_a"))
    out = pairs.withColumn("structural", F.when(better, "second").otherwise("first"))
    chosen = F.when(F.col("structural") == "second", F.col("p_b")).otherwise(F.col("p_a"))
    out = out.withColumn("needed", (chosen >= IDENTITY_PENALTY) | (F.abs(F.col("p_a") - F.col("p_b")) <= CLOSE))
    out = out.withColumn("aware", F.col("needed") & F.col("s_a").isNotNull() & F.col("s_b").isNotNull())
    by_score = F.when(F.col("s_b") + DEAD_BAND < F.col("s_a"), "second").when(F.col("s_a") + DEAD_BAND < F.col("s_b"), "first").otherwise(F.col("structural"))
    return out.withColumn("which", F.when(F.col("aware"), by_score).otherwise(F.col("structural")))


def _analysed(turns: DataFrame, audio: DataFrame) -> DataFrame:
    return over(turns.sparkSession, f"WITH {STRUCTURE} SELECT source_id, CAST(speaker_count AS BIGINT) AS n, penalty AS p, {_RETRY} AS reason FROM scored", {"turns": turns.withColumnRenamed("speaker", "raw_speaker"), "segments": audio})


def select_passes(first: DataFrame, second, audio: DataFrame, jobs: DataFrame) -> DataFrame:
    """A row a source: both passes, the first look, the budget and the choice, in the columns that raw_candidate() reads and more.

    first: the first pass; second: a function that gives the second pass of a table of (source_id, threshold). audio: source_id,
    end_ms. jobs: as for budget_skip(), by source_id; a source without a job has no budget. Sources without valid turns have no row."""
    first = written(first, "first-pass")
    a = written(_analysed(first, audio), "first-analysis")
    due = a.where("reason IS NOT NULL").select("source_id", F.when(F.col("reason").isin(*FRAGMENTED), FEWER_THRESHOLD).otherwise(MORE_THRESHOLD).alias("threshold"))
    again = written(second(due), "second-pass")
    b = _analysed(again, audio.join(due.select("source_id"), "source_id", "left_semi")).select("source_id", F.col("n").alias("n_b"), F.col("p").alias("p_b"))
    key = lambda df, k: df.withColumn("source_id", F.col("source_id") * 2 + k)
    ours = due.select("source_id")
    both = key(first.join(ours, "source_id", "left_semi"), 0).unionByName(key(again.select(*first.columns), 1))
    heard = audio.join(ours, "source_id", "left_semi").select("source_id", "end_ms")
    look = light_identity(both, key(heard, 0).unionByName(key(heard, 1)))[1]
    look = written(look.select("source_id", F.col("speaker_count").alias("n"), F.col("penalty").alias("p"), "identity_penalty", "overall_confidence", "low"), "look")
    side = lambda k, x: look.where(F.col("source_id") % 2 == k).select(F.floor(F.col("source_id") / 2).cast("long").alias("source_id"), *(F.col(c).alias(f"{c}_{x}") for c in ("identity_penalty", "overall_confidence", "low")), F.col("n").alias(f"look_n_{x}"), F.col("p").alias(f"look_p_{x}"))
    rows = a.select("source_id", F.col("n").alias("n_a"), F.col("p").alias("p_a"), "reason")
    for other in (due, b, side(0, "a"), side(1, "b"), budget_skip(jobs)):
        rows = rows.join(other, "source_id", "left")
    rows = precheck(rows.withColumns({"speakers_before": F.col("n_a"), "speakers_after": F.col("look_n_a").cast("long"), "look_penalty": F.col("look_p_a"), "low": F.col("low_a"), "skip": F.coalesce("skip", F.lit(False))}))
    rows = rows.withColumn("retry", F.col("reason").isNotNull() & ~F.col("accepted") & ~F.col("skipped"))
    scores = {f"s_{x}": F.round(F.col(f"look_p_{x}") + F.col(f"identity_penalty_{x}"), 6) for x in "ab"}
    # A second pass without valid turns is as bad as one without speakers.
    rows = choose(rows.withColumns({"n_b": F.when(F.col("retry"), F.coalesce("n_b", F.lit(0))), "p_b": F.when(F.col("retry"), F.coalesce("p_b", F.lit(8.0)))} | scores))
    reason = (
        F.when(F.col("reason").isNull(), "primera_pasada_estable").when(F.col("accepted"), "precheck_identidad_evito_segunda_pasada").when(F.col("skipped"), "presupuesto_tiempo_omite_segunda_pasada")
        .when(F.col("aware"), F.concat(F.lit("seleccion_identity_aware_"), "which")).when(F.col("which") == "second", "segunda_pasada_mejora_estructura").otherwise("se_conserva_primera_pasada")
    )
    took = F.col("retry") & (F.col("which") == "second")
    one = F.struct(F.lit(FIRST_THRESHOLD).alias("threshold"), F.struct(F.col("n_a").alias("speaker_count"), F.round("p_a", 6).alias("penalty")).alias("analysis"))
    two = F.struct(F.col("threshold").alias("threshold"), F.struct(F.col("n_b").alias("speaker_count"), F.round("p_b", 6).alias("penalty")).alias("analysis"))
    aware = F.when(F.col("aware") & F.col("retry"), F.struct(F.lit(True).alias("enabled"), F.col("which").alias("selected_candidate"), F.col("s_a").alias("first_score"), F.col("s_b").alias("second_score")))
    check = F.when(F.col("applies"), F.struct(F.lit(True).alias("enabled"), "accepted", "speakers_before", "speakers_after", F.col("look_penalty").alias("structural_penalty"), F.col("identity_penalty_a").alias("identity_penalty"), F.col("overall_confidence_a").alias("identity_confidence")))
    return rows.select(
        "source_id", "reason", "retry", F.when(F.col("retry"), F.array(one, two)).otherwise(F.array(one)).alias("candidates"), aware.alias("identity_aware_selection"), check.alias("auto_precheck"), F.col("accepted").alias("retry_avoided"),
        F.col("skipped").alias("retry_skipped_budget"), reason.alias("selection_reason"), F.when(took, F.col("threshold")).otherwise(F.lit(FIRST_THRESHOLD)).alias("selected_threshold"), F.col("needed").alias("identity_needed"),
        F.when(took, F.col("n_b")).otherwise(F.col("n_a")).alias("selected_speakers"), F.when(took, F.col("p_b")).otherwise(F.col("p_a")).alias("selected_penalty"),
        F.when(F.col("retry"), F.abs(F.col("n_b") - F.col("n_a"))).alias("stability_delta"), F.col("budget_s"), F.col("projected_s"),
    )


def overridden(validation: DataFrame) -> DataFrame:
    """validated() rows with retry_skipped_budget, and budget_limited: a count whose second pass the budget ruled out is ambiguous."""
    skipped = F.coalesce("retry_skipped_budget", F.lit(False))
    return validation.withColumn("status", F.when(skipped, "estimacion_ambigua_presupuesto").otherwise(F.col("status"))).withColumn("label", F.when(skipped, "resultado ambiguo; revisar hablantes").otherwise(F.col("label"))).withColumn("ambiguous", F.col("ambiguous") | skipped).withColumn("budget_limited", skipped)


def profiles(spark, sf_dir) -> DataFrame:
    """source_id, profile of the jobs: what their last event stands for."""
    last = views.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return last.select("source_id", F.when(F.col("last") == "click", "Rápido").when(F.col("last") == "view", "Equilibrado").when(F.col("last") == "purchase", "Preciso").otherwise("Personalizado").alias("profile"))


#: Labels that a pass of a profile takes for one speaker: a coarser pass takes twice as many, a finer one half.
WIDTHS = {"Rápido": 4, "Equilibrado": 2, "Preciso": 1}
WIDEST = 10


def _coarse(speaker: Column, width: Column) -> Column:
    return F.floor(speaker / width).cast("int")


def _passes(spark, sf_dir) -> DataFrame:
    """The passes of the sources that have vectors: labels of the table are their finest clusters."""
    own = profiles(spark, sf_dir)
    width = F.coalesce(*(F.when(F.col("profile") == k, v) for k, v in WIDTHS.items()), F.lit(WIDEST))
    turns = views.turn_embeddings(spark, sf_dir).join(own, "source_id", "left").withColumn("_w", width).drop("profile")

    def second(due: DataFrame) -> DataFrame:
        held = turns.join(due, "source_id")
        again = F.when(F.col("threshold") > FIRST_THRESHOLD, F.col("_w") * 2).otherwise(F.greatest(F.lit(1), F.floor(F.col("_w") / 2)))
        return held.withColumn("speaker", _coarse(F.col("speaker"), again)).drop("_w", "threshold")

    m = views.job_metrics(spark, sf_dir).join(own, F.col("job_id") == own["source_id"]).drop("job_id")
    ratio = F.coalesce(*(F.when(F.col("profile") == k, v) for k, v in RATIOS.items()))
    seconds = lambda c: F.col(c) / 100.0
    jobs = m.select("source_id", F.greatest(F.lit(0.0), F.col("audio_cs") * ratio / 10000.0 - F.col("asr_cs") / 100.0 - RESERVE_CS / 100.0).alias("budget_s"), seconds("model_load_cs").alias("elapsed_s"), seconds("overhead_cs").alias("precheck_s"), seconds("diarization_cs").alias("first_pass_s"))
    return select_passes(turns.withColumn("speaker", _coarse(F.col("speaker"), F.col("_w"))).drop("_w"), second, turns.select("source_id", "end_ms"), jobs)


def identity_aware_selection(spark, sf_dir):
    sel = F.col("identity_aware_selection")
    return _passes(spark, sf_dir).where("retry").select("source_id", "reason", "identity_needed", sel.isNotNull().alias("aware"), sel["first_score"].alias("first_score"), sel["second_score"].alias("second_score"), "selection_reason", "selected_threshold", "selected_speakers")


def precheck_decision(spark, sf_dir):
    pre = F.col("auto_precheck")
    return _passes(spark, sf_dir).where(pre.isNotNull()).select("source_id", "reason", pre["speakers_before"].alias("speakers_before"), pre["speakers_after"].alias("speakers_after"), pre["structural_penalty"].alias("structural_penalty"), pre["identity_penalty"].alias("identity_penalty"), pre["identity_confidence"].alias("identity_confidence"), pre["accepted"].alias("accepted"), F.round("projected_s", 6).alias("projected_s"), "retry_skipped_budget")


def raw_candidate_query(spark, sf_dir):
    return raw_candidate(_passes(spark, sf_dir)).select("source_id", "selection_reason", "candidate", "index", "speaker_count", "threshold")


def budget_override(spark, sf_dir):
    """Counts of the chosen passes, validated: those whose second pass the budget ruled out are ambiguous."""
    held = _passes(spark, sf_dir).select("source_id", F.col("selected_speakers").alias("speakers"), F.col("selected_penalty").alias("penalty"), "retry", F.col("stability_delta").alias("delta"), F.lit(None).cast("long").alias("manual"), F.col("auto_precheck.identity_confidence").alias("confidence"), "retry_skipped_budget")
    return overridden(validated(held)).select("source_id", "speakers", "structural_status", "status", "ambiguous", "budget_limited", "label")


def light_sql(name: str, turns: str) -> str:
    """DuckDB tables of a light look at `turns`, all stages in one text; <name> has a row a source."""
    d = _Dialect(False)
    return f"""{name}_heard AS (WITH turn_embeddings AS (SELECT * FROM {turns}), {_sampling(3, 18)} SELECT t.source_id, t.turn_index, start_ms, end_ms, t.speaker, CASE WHEN p.turn_index IS NOT NULL THEN embedding END AS embedding FROM turn_embeddings t LEFT JOIN picked p ON t.source_id = p.source_id AND t.turn_index = p.turn_index),
{name}_ref AS (WITH RECURSIVE turn_embeddings AS (SELECT * FROM {name}_heard), {d.refined(4)} SELECT source_id, turn_index, start_ms, end_ms, speaker, embedding, was, made FROM e4 UNION ALL SELECT source_id, turn_index, start_ms, end_ms, speaker, embedding, speaker, NULL FROM turn_embeddings WHERE NOT coalesce({_VOICED}, false)),
{name}_s AS (WITH turns AS (SELECT *, speaker AS raw_speaker FROM {name}_ref), segments AS (SELECT * FROM {turns}), {STRUCTURE} SELECT source_id, speaker_count, turn_count, round(penalty, 6) AS penalty FROM scored),
{name}_o AS (WITH turn_embeddings AS (SELECT * FROM {name}_ref), {d.summary()}, {_OVERALL} SELECT source_id, overall_confidence, low, penalty AS identity_penalty FROM overall),
{name} AS (SELECT * FROM {name}_s JOIN {name}_o USING (source_id))"""


_CLOSEST = "WITH turns AS (SELECT *, speaker AS raw_speaker FROM {t}), segments AS (SELECT * FROM {t}), " + STRUCTURE
PASSES_SQL = f"""WITH prof AS (SELECT user_id, coalesce(MAP {{'click': 'Rápido', 'view': 'Equilibrado', 'purchase': 'Preciso'}}[arg_max(event_type, (ts, event_id))], 'Personalizado') AS profile FROM events GROUP BY user_id),
wide AS (SELECT t.*, coalesce(MAP {{'Rápido': 4, 'Equilibrado': 2, 'Preciso': 1}}[profile], 10) AS w FROM turn_embeddings t LEFT JOIN prof ON user_id = t.source_id),
pa AS (SELECT source_id, turn_index, start_ms, end_ms, (speaker // w)::INTEGER AS speaker, embedding FROM wide),
an_a AS ({_CLOSEST.format(t='pa')} SELECT source_id, speaker_count, penalty, {_RETRY} AS reason FROM scored),
pb AS (SELECT source_id, turn_index, start_ms, end_ms, (speaker // (CASE WHEN reason IN ('sobredeteccion_extrema', 'fragmentacion_excesiva') THEN 2 * w ELSE greatest(1, w // 2) END))::INTEGER AS speaker, embedding FROM wide JOIN an_a USING (source_id) WHERE reason IS NOT NULL),
an_b AS ({_CLOSEST.format(t='pb')} SELECT source_id, speaker_count, penalty FROM scored),
da AS (SELECT pa.* FROM pa JOIN an_a USING (source_id) WHERE reason IS NOT NULL),
{light_sql('la', 'da')},
{light_sql('lb', 'pb')},
job AS (SELECT job_id, model_load_cs + overhead_cs + diarization_cs AS spent, greatest(0, audio_cs * MAP {{'Rápido': 85, 'Equilibrado': 100, 'Preciso': 150}}[profile] / 100.0::DOUBLE - asr_cs - 500) AS budget FROM job_metrics JOIN prof ON user_id = job_id),
x AS (SELECT an_a.source_id, an_a.reason, an_a.speaker_count AS n_a, an_a.penalty AS p_a, an_b.speaker_count AS n_b, an_b.penalty AS p_b, la.speaker_count AS l_n, la.penalty AS l_p, la.identity_penalty AS l_i, la.overall_confidence AS l_c, la.low AS l_low, round(la.penalty + la.identity_penalty, 6) AS s_a, round(lb.penalty + lb.identity_penalty, 6) AS s_b,
  CASE WHEN budget IS NOT NULL THEN spent / 100.0::DOUBLE END AS projected, coalesce(spent > budget, false) AS late, an_a.reason IN ('sobredeteccion_extrema', 'fragmentacion_excesiva') AS frag FROM an_a LEFT JOIN an_b USING (source_id) LEFT JOIN la USING (source_id) LEFT JOIN lb USING (source_id) LEFT JOIN job ON job_id = an_a.source_id),
y AS (SELECT *, coalesce(frag AND l_n BETWEEN 2 AND 8 AND l_n < n_a AND l_p <= 2.6 AND l_low = 0, false) AS settled, p_b + 0.25 * greatest(0, abs(n_b - n_a) - 2) AS p_x FROM x),
z AS (SELECT *, coalesce(frag AND NOT settled AND late, false) AS skipped, reason IS NOT NULL AND NOT settled AND NOT coalesce(frag AND late, false) AS again, CASE WHEN reason[-8:] = '_extrema' THEN n_b BETWEEN 2 AND 8 AND p_x - p_a <= 0.5 ELSE p_a - p_x > 0.1 END AS by_form FROM y),
v AS (SELECT *, (CASE WHEN by_form THEN p_b ELSE p_a END >= 2 OR abs(p_a - p_b) <= 1) AS needed FROM z),
u AS (SELECT *, needed AND s_a IS NOT NULL AND s_b IS NOT NULL AS aware, CASE WHEN needed AND abs(s_a - s_b) > 0.15 AND (s_b + 0.15 < s_a OR s_a + 0.15 < s_b) THEN s_b < s_a ELSE by_form END AS wins FROM v),
r AS (SELECT *, CASE WHEN reason IS NULL THEN 'primera_pasada_estable' WHEN settled THEN 'precheck_identidad_evito_segunda_pasada' WHEN skipped THEN 'presupuesto_tiempo_omite_segunda_pasada' WHEN aware THEN 'seleccion_identity_aware_' || CASE WHEN wins THEN 'second' ELSE 'first' END WHEN wins THEN 'segunda_pasada_mejora_estructura' ELSE 'se_conserva_primera_pasada' END AS why,
  again AND wins AS took, CASE WHEN frag THEN 0.82::DOUBLE ELSE 0.68::DOUBLE END AS th FROM u)"""

OWN = {
    "identity_aware_selection": (identity_aware_selection, f"{PASSES_SQL} SELECT source_id, reason, needed AS identity_needed, aware, CASE WHEN aware THEN s_a END AS first_score, CASE WHEN aware THEN s_b END AS second_score, why AS selection_reason, CASE WHEN took THEN th ELSE 0.74::DOUBLE END AS selected_threshold, CASE WHEN took THEN n_b ELSE n_a END AS selected_speakers FROM r WHERE again"),
    "precheck_decision": (precheck_decision, f"{PASSES_SQL} SELECT source_id, reason, n_a AS speakers_before, l_n AS speakers_after, l_p AS structural_penalty, l_i AS identity_penalty, l_c AS identity_confidence, settled AS accepted, round(projected, 6) AS projected_s, skipped AS retry_skipped_budget FROM r WHERE frag"),
    "raw_candidate": (raw_candidate_query, f"{PASSES_SQL} SELECT source_id, why AS selection_reason, CASE WHEN took THEN 'second' ELSE 'first' END AS candidate, took::INTEGER AS index, CASE WHEN took THEN n_b ELSE n_a END AS speaker_count, CASE WHEN took THEN th ELSE 0.74::DOUBLE END AS threshold FROM r"),
    "budget_override": (budget_override, f"""{PASSES_SQL}, m AS (SELECT *, CASE WHEN took THEN p_b ELSE p_a END AS p, CASE WHEN took THEN n_b ELSE n_a END AS n, CASE WHEN frag THEN l_c ELSE 'sin_datos' END AS conf FROM r),
k AS (SELECT *, CASE WHEN again AND abs(n_b - n_a) > 3 THEN 'estimacion_inestable' WHEN p >= 2 THEN 'estimacion_sospechosa' WHEN again THEN 'estimacion_estable_tras_reintento' ELSE 'estimacion_acustica_estable' END AS st FROM m),
q AS (SELECT *, CASE WHEN skipped THEN 'estimacion_ambigua_presupuesto' WHEN conf = 'baja' THEN 'estimacion_sospechosa_identidad' WHEN conf <> 'alta' AND contains(st, 'estable') THEN CASE WHEN st = 'estimacion_inestable' THEN st ELSE 'estimacion_con_reservas_identidad' END ELSE st END AS status FROM k)
SELECT source_id, n AS speakers, st AS structural_status, status, status NOT IN ('estimacion_estable_tras_reintento', 'estimacion_acustica_estable') AS ambiguous, skipped AS budget_limited,
  CASE status WHEN 'estimacion_estable_tras_reintento' THEN 'confianza media' WHEN 'estimacion_acustica_estable' THEN 'confianza estructural alta' ELSE 'resultado ambiguo; revisar hablantes' END AS label FROM q"""),
}
LIGHT_ORACLE = f"""WITH every AS (SELECT * FROM turn_embeddings), {light_sql('la', 'every')}, x AS (WITH {_sampling(3, 18)} SELECT source_id AS x_id, count(*) AS picked_n FROM picked GROUP BY source_id),
y AS (SELECT source_id AS y_id, count(*) FILTER (end_ms - start_ms BETWEEN 800 AND 17999) AS eligible, count(*) FILTER (end_ms - start_ms < 800) AS skipped_short, count(*) FILTER (end_ms - start_ms >= 18000) AS skipped_long FROM turn_embeddings GROUP BY source_id),
z AS (SELECT source_id AS z_id, count(DISTINCT was) AS speakers_before, count(DISTINCT speaker) AS speakers_after, count(*) FILTER (was <> speaker) AS reassigned_turns, count(DISTINCT made) AS new_identities FROM la_ref GROUP BY source_id)
SELECT source_id, eligible, picked_n AS selected, picked_n AS attempted, picked_n AS computed, skipped_short, skipped_long, eligible > picked_n AS capped, speakers_before, speakers_after, reassigned_turns, new_identities, speaker_count, turn_count, penalty, overall_confidence, identity_penalty, low FROM la JOIN x ON x_id = source_id JOIN y ON y_id = source_id JOIN z ON z_id = source_id"""
