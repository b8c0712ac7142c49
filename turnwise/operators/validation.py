"""Speaker counts: what each stage of a job counted, and how far the count can be trusted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.operators.identity import _Dialect
from turnwise.operators.intervals import assign_speakers
from turnwise.operators.structure import _RETRY, STRUCTURE, STRUCTURE_B
from turnwise.plans.query import over
from turnwise.plans.shared import written
from turnwise.sources import views


def validated(jobs: DataFrame) -> DataFrame:
    """jobs (speakers, penalty, retry, delta, manual, confidence) with structural_status, status, label and ambiguous.

    manual: the count that the user asked for, else null. confidence: the overall one of the identities, null where there is none."""
    structural = (
        F.when(F.col("manual").isNotNull(), "conteo_fijado_por_usuario").when(F.coalesce("speakers", F.lit(0)) <= 0, "sin_estimacion")
        .when(F.coalesce("retry", F.lit(False)) & (F.coalesce("delta", F.lit(0)) > 3), "estimacion_inestable").when(F.coalesce("penalty", F.lit(0.0)) >= 2.0, "estimacion_sospechosa")
        .when(F.coalesce("retry", F.lit(False)), "estimacion_estable_tras_reintento").otherwise("estimacion_acustica_estable")
    )
    overall = F.coalesce(F.nullif("confidence", F.lit("")), F.lit("sin_datos"))
    now = F.col("structural_status")
    stable = now.isin("estimacion_acustica_estable", "estimacion_estable_tras_reintento")
    status = F.when(now == "conteo_fijado_por_usuario", now).when(overall == "baja", "estimacion_sospechosa_identidad").when(overall.isin("media", "sin_datos") & stable, "estimacion_con_reservas_identidad").otherwise(now)
    doubtful = F.col("status").isin("estimacion_sospechosa", "estimacion_inestable", "estimacion_sospechosa_identidad", "estimacion_con_reservas_identidad")
    label = (
        F.when(F.col("ambiguous"), "resultado ambiguo; revisar hablantes").when(F.col("status") == "estimacion_estable_tras_reintento", "confianza media")
        .when(F.col("status") == "estimacion_acustica_estable", "confianza estructural alta").when(F.col("status") == "conteo_fijado_por_usuario", "conteo fijado por usuario").otherwise("confianza no determinada")
    )
    out = jobs.withColumn("structural_status", structural).withColumn("status", status)
    return out.withColumn("ambiguous", F.col("manual").isNull() & doubtful).withColumn("label", label)


def snapshot(jobs: DataFrame) -> DataFrame:
    """jobs (raw, engine, identity_ids, assigned_ids) with what the stages counted and which identities got no text.

    raw: speakers of the chosen pass; engine: after refinement. Null or zero counts fall back, engine to raw and raw to engine. The
    audited identities decide where there are any; null lists are empty."""
    ids = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<int>")))))
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    out = jobs.withColumn("identity_ids", ids("identity_ids")).withColumn("assigned_ids", ids("assigned_ids"))
    raw, engine = F.coalesce(some("raw"), some("engine"), F.lit(0)), F.coalesce(some("engine"), some("raw"), F.lit(0))
    audited = F.size("identity_ids")
    loose = F.array_except("identity_ids", "assigned_ids")
    return out.select(
        *[c for c in jobs.columns if c not in ("raw", "engine", "identity_ids", "assigned_ids")], raw.cast("long").alias("raw_acoustic_clusters"), engine.cast("long").alias("engine_identity_clusters"), audited.cast("long").alias("identity_consistency_clusters"),
        F.when(audited > 0, audited).otherwise(engine).cast("long").alias("identity_clusters_after_refinement"), F.size("assigned_ids").cast("long").alias("text_assigned_speakers"), F.size(loose).cast("long").alias("unassigned_acoustic_clusters"),
        loose.alias("unassigned_raw_ids"), F.when(audited > 0, F.array_except("assigned_ids", "identity_ids")).otherwise(F.array().cast("array<int>")).alias("text_ids_missing_from_identity_audit"), ((audited > 0) & (engine != audited)).alias("identity_count_mismatch"),
    )


#: Both passes of a job: all its turns, and, where the first looks wrong, those of 1.5 s and more. The user fixed the count of jobs
#: whose audio is under half a minute.
_JOBS = """jobs AS (SELECT a.source_id, CAST(a.speaker_count AS BIGINT) AS speakers, a.penalty AS penalty, a.reason IS NOT NULL AS retry, CAST(abs(coalesce(b.speaker_count, 0) - a.speaker_count) AS BIGINT) AS delta,
  CASE WHEN a.audio_s < 30 THEN 2 END AS manual FROM (SELECT *, {retry} AS reason FROM scored) a LEFT JOIN scored_b b ON a.source_id = b.source_id)"""
_JOBS = _JOBS.replace("{retry}", _RETRY)
_CONFIDENCE = "n AS (SELECT source_id AS n_id, CAST(sum(CASE WHEN confidence = 'baja' THEN 1 ELSE 0 END) AS BIGINT) AS low, CAST(sum(CASE WHEN confidence IN ('media', 'sin_datos', 'insuficiente') THEN 1 ELSE 0 END) AS BIGINT) AS doubts FROM verdict GROUP BY source_id)"


_SUMMARY = _Dialect(True).summary().replace("turn_embeddings", "sampled_turns")


def count_validation(spark, sf_dir):
    # Written once, as both passes and every part of the summary read them.
    tables = {n: written(views.VIEWS[n](spark, sf_dir), n) for n in ("segments", "turns", "sampled_turns")}
    jobs = over(spark, f"WITH {STRUCTURE}, {STRUCTURE_B}, {_JOBS} SELECT * FROM jobs", tables)
    own = over(spark, f"WITH {_SUMMARY}, {_CONFIDENCE} SELECT n_id, CASE WHEN low > 0 THEN 'baja' WHEN doubts > 0 THEN 'media' ELSE 'alta' END AS confidence FROM n", tables)
    jobs = jobs.join(own, F.col("source_id") == F.col("n_id"), "left")
    return validated(jobs).select("source_id", "speakers", "retry", "structural_status", "status", "ambiguous", "label")


VALIDATION_ORACLE = f"""WITH {_Dialect(False).summary().replace('turn_embeddings', 'sampled_turns')}, {_CONFIDENCE}, {STRUCTURE}, {STRUCTURE_B}, {_JOBS},
j AS (SELECT jobs.*, CASE WHEN n.low > 0 THEN 'baja' WHEN n.doubts > 0 THEN 'media' WHEN n.low = 0 THEN 'alta' ELSE 'sin_datos' END AS conf FROM jobs LEFT JOIN n ON n_id = source_id),
rules(rank, structural_status) AS (VALUES (1, 'conteo_fijado_por_usuario'), (2, 'sin_estimacion'), (3, 'estimacion_inestable'), (4, 'estimacion_sospechosa'), (5, 'estimacion_estable_tras_reintento'), (6, 'estimacion_acustica_estable')),
r AS (SELECT *, list_position([manual IS NOT NULL, speakers <= 0, retry AND delta > 3, penalty >= 2.0, retry, true], true) AS rank FROM j),
s AS (SELECT r.*, structural_status, CASE WHEN r.rank = 1 THEN structural_status WHEN conf = 'baja' THEN 'estimacion_sospechosa_identidad' WHEN conf <> 'alta' AND r.rank >= 5 THEN 'estimacion_con_reservas_identidad' ELSE structural_status END AS status FROM r JOIN rules USING (rank))
SELECT source_id, speakers, retry, structural_status, status, status[:10] = 'estimacion' AND status NOT IN ('estimacion_acustica_estable', 'estimacion_estable_tras_reintento') AS ambiguous,
  CASE WHEN status[:10] = 'estimacion' AND status NOT IN ('estimacion_acustica_estable', 'estimacion_estable_tras_reintento') THEN 'resultado ambiguo; revisar hablantes'
  ELSE MAP {{'estimacion_estable_tras_reintento': 'confianza media', 'estimacion_acustica_estable': 'confianza estructural alta', 'conteo_fijado_por_usuario': 'conteo fijado por usuario', 'sin_estimacion': 'confianza no determinada'}}[status] END AS label FROM s"""


def snapshots(spark, sf_dir) -> DataFrame:
    """Raw: all speakers of the turns; engine: those of valid turns; audited: those with a turn of 0.8 s; assigned: those that
    segments of 3 s and more overlap most."""
    turns, segments = views.turns(spark, sf_dir), views.segments(spark, sf_dir)
    long = segments.where("end_ms - start_ms >= 3000").select("source_id", "seg_id", "start_ms", "end_ms")
    given = assign_speakers(long, turns, ["source_id", "seg_id"]).groupBy("source_id").agg(F.collect_set("speaker").alias("assigned_ids"))
    valid = F.col("end_ms") > F.col("start_ms")
    jobs = turns.groupBy("source_id").agg(
        F.countDistinct("raw_speaker").alias("raw"), F.countDistinct(F.when(valid, F.col("raw_speaker"))).alias("engine"), F.collect_set(F.when(F.col("end_ms") - F.col("start_ms") >= 800, F.col("raw_speaker"))).alias("identity_ids")
    )
    return snapshot(jobs.join(given, "source_id", "left"))


def speaker_count_snapshot(spark, sf_dir):
    out = snapshots(spark, sf_dir)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select(*[text(c) if c in ("unassigned_raw_ids", "text_ids_missing_from_identity_audit") else c for c in out.columns])


def _snapshot_oracle() -> str:
    from turnwise.operators.intervals import _duck_speakers

    return f"""WITH {_duck_speakers('(SELECT * FROM segments WHERE end_ms - start_ms >= 3000)', 'source_id, seg_id', -1)},
given AS (SELECT DISTINCT source_id, s AS id FROM overlap UNION SELECT DISTINCT source_id, s FROM near ANTI JOIN overlap USING (source_id, seg_id)),
audit AS (SELECT DISTINCT source_id, raw_speaker AS id FROM turns WHERE end_ms - start_ms >= 800),
c AS (SELECT source_id, count(DISTINCT raw_speaker) AS raw, count(DISTINCT raw_speaker) FILTER (end_ms > start_ms) AS engine FROM turns GROUP BY source_id),
loose AS (SELECT source_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM audit ANTI JOIN given USING (source_id, id) GROUP BY source_id),
extra AS (SELECT source_id, string_agg(id, ',' ORDER BY id) AS ids FROM given g WHERE EXISTS (SELECT 1 FROM audit a WHERE a.source_id = g.source_id) AND NOT EXISTS (SELECT 1 FROM audit a WHERE a.source_id = g.source_id AND a.id = g.id) GROUP BY source_id),
a AS (SELECT source_id, count(*) AS n FROM audit GROUP BY source_id), t AS (SELECT source_id, count(*) AS n FROM given GROUP BY source_id)
SELECT c.source_id, raw AS raw_acoustic_clusters, coalesce(nullif(engine, 0), raw) AS engine_identity_clusters, coalesce(a.n, 0) AS identity_consistency_clusters, coalesce(a.n, nullif(engine, 0), raw) AS identity_clusters_after_refinement,
  coalesce(t.n, 0) AS text_assigned_speakers, coalesce(loose.n, 0) AS unassigned_acoustic_clusters, coalesce(loose.ids, '') AS unassigned_raw_ids, coalesce(extra.ids, '') AS text_ids_missing_from_identity_audit,
  coalesce(a.n <> coalesce(nullif(engine, 0), raw), false) AS identity_count_mismatch
FROM c LEFT JOIN a USING (source_id) LEFT JOIN t USING (source_id) LEFT JOIN loose USING (source_id) LEFT JOIN extra USING (source_id)"""


OWN = {"count_validation": (count_validation, VALIDATION_ORACLE), "speaker_count_snapshot": (speaker_count_snapshot, _snapshot_oracle())}
