"""The choice between two passes, by literal cases."""

import pytest
from pyspark.sql import functions as F

from turnwise.operators import candidates as c

META = "name string, candidates array<struct<threshold:double,analysis:struct<speaker_count:bigint>>>, identity_aware_selection struct<enabled:boolean,selected_candidate:string>, retry_avoided boolean, selection_reason string, retry boolean, selected_threshold double"
TWO = [(0.74, (9,)), (0.82, (7,))]


@pytest.mark.parametrize(
    ("meta", "want"),
    [
        ((TWO, (True, "second"), None, "seleccion_identity_aware_second", None, None), ("second", 1, 7, 0.82)),
        ((TWO, (True, "first"), None, "segunda_pasada_mejora_estructura", True, 0.82), ("first", 0, 9, 0.74)),
        ((TWO, (False, "other"), True, "segunda_pasada_mejora_estructura", True, 0.82), ("first", 0, 9, 0.74)),
        ((TWO, None, False, "segunda_pasada_mejora_estructura", True, 0.74), ("second", 1, 7, 0.82)),
        ((TWO, None, None, "presupuesto_tiempo_omite_segunda_pasada", True, 0.82), ("first", 0, 9, 0.74)),
        ((TWO, None, None, "", True, 0.82 + 5e-10), ("second", 1, 7, 0.82)),
        ((TWO, None, None, None, True, 0.82 + 2e-9), ("first", 0, 9, 0.74)),
        ((TWO, None, None, None, False, 0.82), ("first", 0, 9, 0.74)),
        ((TWO, None, None, None, True, None), ("first", 0, 9, 0.74)),
        (([(0.74, None)], None, None, "seleccion_identity_aware_second", True, None), ("second", 1, 0, None)),
        (([(0.74, None)], None, None, None, None, None), ("first", 0, 0, 0.74)),
        (([], None, None, None, None, None), ("first", 0, 0, None)),
        ((None, None, None, None, None, None), ("first", 0, 0, None)),
        (([(0.74, (9,)), (None, (3,))], None, None, "x", True, 0.74), ("first", 0, 9, 0.74)),
    ],
)
def test_raw_candidate(spark, meta, want):
    row = c.raw_candidate(spark.createDataFrame([("n", *meta)], META)).first()
    assert (row.candidate, row["index"], row.speaker_count, row.threshold) == want and row.name == "n"


def test_budget_skip(spark):
    rows = [(None, 5.0, 5.0, 5.0), (10.0, 2.0, 3.0, 5.0), (10.0, 2.0, 3.0, 5.01), (10.0, -9.0, None, 10.5), (-3.0, 0.0, 0.0, 0.1), (0.0, None, None, None)]
    got = c.budget_skip(spark.createDataFrame(rows, "budget_s double, elapsed_s double, precheck_s double, first_pass_s double")).collect()
    assert [(r.skip, r.projected_s) for r in got] == [(False, None), (False, 10.0), (True, 10.01), (True, 10.5), (True, 0.1), (False, 0.0)]


def test_precheck(spark):
    rows = [
        ("sobredeteccion_extrema", 9, 7, 2.4, 0, True), ("fragmentacion_excesiva", 9, 9, 1.0, 0, False), ("sobredeteccion_extrema", 12, 9, 1.0, 0, True), ("sobredeteccion_extrema", 9, 1, 1.0, 0, False), ("sobredeteccion_extrema", 9, 7, 2.61, 0, True),
        ("sobredeteccion_extrema", 9, 7, 2.6, 1, False), ("subdeteccion_extrema", 9, 7, 1.0, 0, True), (None, 9, 7, 1.0, 0, True), ("fragmentacion_excesiva", 9, None, None, None, True), ("fragmentacion_excesiva", 3, 2, None, None, None),
    ]
    got = c.precheck(spark.createDataFrame(rows, "reason string, speakers_before long, speakers_after long, look_penalty double, low long, skip boolean")).collect()
    t, f = True, False
    assert [(r.applies, r.accepted, r.skipped) for r in got] == [(t, t, f), (t, f, f), (t, f, t), (t, f, f), (t, f, t), (t, f, f), (f, f, f), (f, f, f), (t, f, t), (t, t, f)]


def test_choose(spark):
    rows = [
        (None, 4, 5.0, 3, 1.0, 5.0, 1.0), (None, 4, 1.0, 4, 1.05, 2.0, 1.0), (None, 4, 1.0, 4, 0.85, 1.0, 1.1), (None, 4, 1.0, 4, 0.85, None, 1.1), (None, 4, 1.2, 4, 1.1, 1.0, 1.16), (None, 9, 4.0, 2, 1.0, 9.0, 9.0),
        ("sobredeteccion_extrema", 9, 2.0, 8, 2.5, 2.0, 2.1), ("sobredeteccion_extrema", 12, 2.0, 9, 0.1, 3.0, 1.0), ("subdeteccion_extrema", 1, 8.0, 5, 8.4, 8.2, 8.2), (None, 3, 4.0, 3, 0.5, 0.0, 9.0),
    ]
    got = c.choose(spark.createDataFrame(rows, "reason string, n_a long, p_a double, n_b long, p_b double, s_a double, s_b double")).collect()
    s, f = "second", "first"
    assert [(r.structural, r.needed, r.aware, r.which) for r in got] == [
        (s, False, False, s), (f, True, True, s), (s, True, True, s), (s, True, False, s), (f, True, True, f), (s, False, False, s), (s, True, True, s), (f, True, True, s), (f, True, True, f), (s, False, False, s)
    ]


def test_override(spark):
    rows = [("estimacion_acustica_estable", False, "confianza estructural alta", True), ("estimacion_sospechosa", True, "resultado ambiguo; revisar hablantes", None), ("conteo_fijado_por_usuario", False, "conteo fijado por usuario", True)]
    got = c.overridden(spark.createDataFrame(rows, "status string, ambiguous boolean, label string, retry_skipped_budget boolean")).collect()
    assert [(r.status, r.ambiguous, r.budget_limited) for r in got] == [("estimacion_ambigua_presupuesto", True, True), ("estimacion_sospechosa", True, False), ("estimacion_ambigua_presupuesto", True, True)]


def test_passes_of_an_empty_table(spark):
    turns = spark.createDataFrame([], "source_id long, turn_index long, start_ms long, end_ms long, speaker int, embedding array<double>")
    jobs = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0)], "source_id long, budget_s double, elapsed_s double, precheck_s double, first_pass_s double")
    assert c.select_passes(turns, lambda due: turns.join(due.select("source_id"), "source_id"), turns.select("source_id", "end_ms"), jobs).count() == 0


def test_budget_rules_out_a_second_pass(spark):
    """Ten speakers with vectors of their own can't be merged by a look, so that only the budget decides whether a second pass runs."""
    rows = [(s, i, 4000 * i, 4000 * i + 3900, i % 10, [1.0 if k == i % 10 else 0.0 for k in range(10)]) for s in (1, 2) for i in range(30)]
    turns = spark.createDataFrame(rows, "source_id long, turn_index long, start_ms long, end_ms long, speaker int, embedding array<double>")
    jobs = spark.createDataFrame([(1, 10.0, 5.0, 1.0, 5.0), (2, 12.0, 5.0, 1.0, 5.0)], "source_id long, budget_s double, elapsed_s double, precheck_s double, first_pass_s double")
    again = lambda due: turns.join(due.select("source_id"), "source_id").withColumn("speaker", F.floor(F.col("speaker") / 5).cast("int"))
    got = {r.source_id: r for r in c.select_passes(turns, again, turns.select("source_id", "end_ms"), jobs).collect()}
    assert got[1].selection_reason == "presupuesto_tiempo_omite_segunda_pasada" and got[1].retry_skipped_budget and len(got[1].candidates) == 1 and got[1].selected_speakers == 10
    assert got[2].retry and len(got[2].candidates) == 2 and got[2].candidates[1].threshold == 0.82 and got[2].candidates[1].analysis.speaker_count == 2 and not got[2].retry_skipped_budget
