"""Documents, revisions and report rows, by literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from turnwise.operators import documents as d

JOB = "source_id long, file string, model string, language string, profile string, glossary string, created_at string"
SEGMENTS = "source_id long, place long, start_ms long, end_ms long, text string, speaker string"
BLOCKS = "source_id long, block int, start_ms long, end_ms long, speaker string, text string, segment_ids string, review_required boolean"


def job(spark, **columns):
    df = spark.createDataFrame([(1, "C:\\audio\\caso.01.wav", "small", None, "Preciso", " uno; dos,,tres \n", "2024-01-02T03:04:05")], JOB)
    return df.withColumns({k: v if hasattr(v, "alias") else F.lit(v) for k, v in columns.items()})


def parts(spark):
    segments = spark.createDataFrame([(1, 0, 0, 1500, " Hola  mundo ", "Ana"), (1, 1, 1500, 2000, "sí\u00a0", "Luis"), (1, 2, 2000, 2500, "", None), (1, 3, 2500, 4000, "ya", "Ana")], SEGMENTS)
    blocks = spark.createDataFrame([(1, 0, 0, 1500, "Ana", "Hola mundo", "0", True), (1, 1, 1500, 4000, "Luis", "sí ya", "1,3", False)], BLOCKS)
    return segments, blocks


MEASURES = dict(audio_seconds=100.0, asr_seconds=20.0, diarization_seconds=30.0, export_seconds=5.0, overhead_seconds=1.0, diarization_enabled=True, speaker_mode="Auto", speaker_detected=3, device="cpu", compute_type="int8", batched=True, batch_size=4, beam_size=5)


def test_closed_measures(spark):
    row = d.closed(job(spark, **MEASURES)).select("*", F.to_json("performance").alias("p")).first()
    assert row.processing_seconds == row.end_to_end_seconds == 56 and row.speed_x == 100 / 56 and row.rtf == 0.56
    assert json.loads(row.p) == {
        "target": "processing_seconds <= audio_seconds", "within_realtime": True, "processing_to_audio": 0.56, "asr_share": 20 / 56, "diarization_share": 30 / 56, "seconds_over_realtime": 0,
        "end_to_end_seconds": 56, "end_to_end_to_audio": 0.56, "end_to_end_within_realtime": True, "end_to_end_seconds_over_realtime": 0,
    }
    none = d.closed(job(spark, audio_seconds=-3.0, asr_seconds=float("nan"))).select("*", F.to_json("performance").alias("p")).first()
    assert (none.asr_seconds, none.rtf, none.speed_x) == (0, None, None) and json.loads(none.p) == {"target": "unknown", "within_realtime": None}


@pytest.mark.parametrize(("version", "more"), [(2, set()), (3, {"configuration", "timing", "diarization"}), (4, {"configuration", "timing", "diarization"}), (5, {"configuration", "timing", "diarization", "alignment"}), (8, {"configuration", "timing", "diarization", "alignment", "performance", "global_profile"})])
def test_layers(spark, version, more):
    doc = json.loads(d.documents(job(spark, **MEASURES), *parts(spark), version=version).first().document)
    assert doc["schema_version"] == version and set(doc) == {"schema_version", "source", "model", "language", "created_at", "profile", "hotwords", "text", "metrics", "segments", "reading_blocks", "speakers", "review"} | more
    assert (doc["source"], doc["language"], doc["hotwords"], doc["text"]) == ("caso.01.wav", "auto", ["uno", "dos", "tres"], "Hola mundo sí ya")
    assert doc["review"] == {"status": "machine_generated", "edited": False, "flagged_blocks": 1}
    assert [s["display_name"] for s in doc["speakers"]] == ["Ana", "Luis"] and doc["speakers"][0]["seconds"] == 3 and doc["segments"][1]["start"] == 1.5 and doc["reading_blocks"][1]["segment_ids"] == [1, 3]
    if version >= 3:
        assert doc["configuration"]["batch_size"] == 4 and doc["diarization"]["detected_speakers"] == 3 and doc["timing"]["asr_seconds"] == 20 and doc["configuration"]["speaker_requested"] is None
    assert ("passes" in doc.get("diarization", ())) == (version >= 4)


def test_open_values(spark):
    counts = F.struct(F.lit(2).alias("raw_acoustic_clusters"), F.array(F.lit(7)).alias("unassigned_raw_ids"))
    doc = json.loads(d.documents(job(spark, speaker_counts=counts, auto_candidates='[{"threshold": 0.74}]', auto_precheck="null", sherpa_internal="not json", auto_retry_requested=True), *parts(spark)).first().document)
    diar = doc["diarization"]
    assert diar["speaker_counts"] == {"raw_acoustic_clusters": 2, "unassigned_raw_ids": [7]} and diar["candidates"] == [{"threshold": 0.74}] and diar["auto_precheck"] == {} == diar["timing"]["sherpa_internal"] and diar["timing"]["passes"] == []
    assert diar["retry_requested"] is True and diar["retry_avoided"] is False and diar["time_budget_seconds"] is None and diar["persistent_worker"] == {"job_index": None, "models_reused": None, "engine_reused": None}


def test_sources_without_segments_and_clashing_columns(spark):
    clash = job(spark, segments=5, text="x", speakers=1, document="y")
    doc = json.loads(d.documents(clash, parts(spark)[0].limit(0), parts(spark)[1].limit(0)).first().document)
    assert doc["segments"] == doc["reading_blocks"] == doc["speakers"] == [] and doc["text"] == "" and doc["review"]["flagged_blocks"] == 0
    assert d.documents(job(spark).limit(0), *parts(spark)).count() == 0


def test_indented_text(spark):
    rows = spark.createDataFrame([('{"a":"é \\u0001","b":[1.5,null,true],"c":{},"d":1.0E10}',), (None,)], "j string").select(d.indented("j")).collect()
    assert rows[0][0] == '{\n  "a": "é \\u0001",\n  "b": [\n    1.5,\n    null,\n    true\n  ],\n  "c": {},\n  "d": 10000000000.0\n}\n' and rows[1][0] is None


def test_reading_documents(spark):
    rows = [("a", '{"schema_version": 8, "text": "t"}'), ("b", ""), ("c", None), ("d", "{"), ("e", "[]"), ("f", '{"text": "no version"}'), ("g", " \n")]
    got = {r.name: r.status for r in d.read_documents(spark.createDataFrame(rows, "name string, text string")).collect()}
    assert got == {"a": "ok", "b": "missing", "c": "missing", "d": "corrupt", "e": "corrupt", "f": "corrupt", "g": "missing"}


def test_revision(spark):
    segments, blocks = parts(spark)
    renames = spark.createDataFrame([(1, "Ana", " Eva "), (1, "Ana", "Zoe"), (1, "Luis", "  "), (1, "Nadie", "X"), (2, "Luis", "Otro")], "source_id long, old string, new string")
    got = {r.name: r.text for r in d.revision(job(spark, **MEASURES), segments, blocks, renames, "20240102_030405").collect()}
    assert set(got) == {f"caso.01_revision_20240102_030405.{k}" for k in ("txt", "md", "json")}
    assert got["caso.01_revision_20240102_030405.txt"] == "[00:00:00] Eva [REVISAR]\nHola mundo\n\n[00:00:01] Luis\nsí ya\n"
    doc = json.loads(got["caso.01_revision_20240102_030405.json"])
    assert doc["review"]["edited"] is True and doc["schema_version"] == 2 and [s["speaker"] for s in doc["segments"]] == ["Eva", "Luis", None, "Eva"] and [s["display_name"] for s in doc["speakers"]] == ["Eva", "Luis"] and doc["reading_blocks"][0]["speaker"] == "Eva"


def test_stems(spark):
    rows = ["/a/audiencia.01.wav", "b\\c.mp3", ".oculto", "sin", "dir.x/f", "", "a..wav"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "f string").select(d.stem(F.col("f"))).collect()]
    assert got == ["audiencia.01", "c", ".oculto", "sin", "f", "", "a."]
    same = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (7, "a")], "source_id long, stem string")
    assert sorted(map(tuple, d.unique_stems(same).collect())) == [(1, "a"), (2, "b"), (3, "a (2)"), (7, "a (3)")]


@pytest.mark.parametrize(
    ("identity", "want"),
    [
        ({}, "sin_datos · 0 turno(s) · 0.0 s · 0 muestra(s) acústica(s) · similitud no evaluable"),
        ({"confidence": "insuficiente", "turns": 1, "embedded_turns": 1, "total_seconds": 4.0, "prototype_similarity_median": 1.0}, "insuficiente · 1 turno(s) · 4.0 s · 1 muestra(s) acústica(s) · muestra única; similitud no evaluable"),
        ({"confidence": "media", "turns": 2, "embedded_turns": 2, "total_seconds": 10.0, "pair_similarity": 0.43, "prototype_similarity_median": 0.85, "rival_similarity_max": 0.75, "max_gap_seconds": 82.0}, "media · 2 turno(s) · 10.0 s · 2 muestra(s) acústica(s) · similitud entre apariciones 0.43 · rival máx 0.75 · separación máx 82.0 s"),
        ({"confidence": "alta", "turns": 5, "embedded_turns": 3, "total_seconds": 12.25, "pair_similarity": 0.1, "prototype_similarity_median": 0.125, "prototype_similarity_min": 0.375, "max_gap_seconds": 3}, "alta · 5 turno(s) · 12.2 s · 3 muestra(s) acústica(s) · prototipo mediana 0.12 · mínimo 0.38"),
    ],
)
def test_identity_sentence(spark, identity, want):
    assert spark.createDataFrame([(json.dumps(identity),)], "j string").select(d.identity_sentence(F.parse_json("j"))).first()[0] == want


def test_report_rows(spark):
    plain = {r.label: r.value for r in d.report(job(spark, **MEASURES)).collect()}
    assert list({r.place for r in d.report(job(spark, **MEASURES)).collect()}) == list(range(len(plain)))
    assert plain["Archivo"] == "caso.01.wav" and plain["Hablantes"] == "Auto · estimación acústica: 3 · con texto: 0 · confianza no determinada" and plain["Duración"] == "00:01:40" and plain["Velocidad"] == "1.79× tiempo real" and plain["Beam"] == "5" and plain["Batch"] == "4"
    assert plain["Presupuesto de rendimiento"] == "cumplido · proceso/audio 0.56×" and plain["Timers internos sherpa"].startswith("no capturados") and "Sherpa clustering" not in plain and "Control identidad V5.2" not in plain and "Validación conteo hablantes" not in plain
    full = job(
        spark, **(MEASURES | {"speaker_mode": "2", "batched": False}), speaker_requested=2, identity_wall_seconds=5.5, diarization_profile="Precisa", sherpa_internal_timing_available=True, sherpa_internal='{"segmentation_seconds": 1.005, "embedding_seconds": "x"}', window_shift_ratio=0.2, diarization_time_budget_seconds=12.0,
        sherpa_pass_timings='[{"pass": 1, "process_wall_seconds": 2.5}, {"pass": 2}]', identity_verification='{"enabled": true, "final_stage_wall_seconds": 3.0, "total_wall_seconds": 5.25}', speaker_counts='{"raw_acoustic_clusters": 4, "identity_clusters_after_refinement": 2, "text_assigned_speakers": 1, "unassigned_raw_ids": [9, 5, 9]}',
        identity_consistency='{"overall_confidence": "baja", "speakers": [{"speaker": 3, "display_name": "Persona 1"}, {"speaker": 5}, {"speaker": 8}]}', speaker_count_validation='{"status": "estimacion_inestable", "ambiguous": true, "ground_truth_available": true}', auto_precheck='{"enabled": true, "wall_seconds": 12, "speakers_before": 9, "speakers_after": 7, "accepted": true}',
    )
    rows = {r.label: r.value for r in d.report(full).collect()}
    assert rows["Hablantes"] == "Solicitados: 2 · acústicos: 2 · con texto: 1" and rows["Batch"] == "secuencial" and rows["Window shift"] == "0.20" and rows["Clusters sherpa seleccionados"] == "4" and rows["Clusters acústicos sin texto"] == "5, 9"
    assert (rows["Sherpa segmentación"], rows["Sherpa embeddings"], rows["Sherpa clustering"]) == ("1.00 s", "—", "0.00 s") and (rows["Sherpa pasada 1 (wall)"], rows["Sherpa pasada 2 (wall)"]) == ("2.50 s", "0.00 s")
    assert rows["Identidad total (wall)"] == "5.25 s" and rows["Identidad etapa final (wall)"] == "3.00 s" and "Identidad ligera (wall)" not in rows and rows["Consistencia identidad"] == "baja" and "Identidad Persona 1" in rows and "Cluster acústico raw 5 (sin texto)" in rows and "Cluster acústico raw 8" in rows
    assert rows["Validación conteo hablantes"] == "estimacion_inestable · acústicos 2 · con texto 1 · ground truth sí · identidad sin_datos" and rows["Precheck rendimiento Auto"] == "12.00 s · 9→7 · aceptado" and rows["Presupuesto diarización Auto"] == "12.00 s" and rows["Rendimiento diarización"].startswith("Precisa prioriza")


def test_speed_is_rounded_by_its_binary_value(spark):
    from turnwise.operators import exports

    speeds = {1: (5425, 1000), 2: (5125, 1000), 3: (5375, 1000), 4: (1005, 1000), 5: (7, 0), 6: (2675, 1000)}
    files = spark.createDataFrame([(k, "a.wav", "small", "", *v) for k, v in speeds.items()], "source_id long, file string, model string, language string, audio_ms long, processing_ms long")
    blocks = spark.createDataFrame([], "source_id long, block int, start_ms long, speaker string, text string, review_required boolean")
    got = {r.source_id: r.text.split("Velocidad:** ")[1].split("×")[0] for r in exports.markdown(blocks, files).collect()}
    assert got == {k: f"{a / p if p else 0:.2f}" for k, (a, p) in speeds.items()}
