"""Literal cases for exports, validation, snapshots, timers and intervals."""

from pyspark.sql import functions as F

from turnwise.functions import scalars
from turnwise.operators import exports, intervals, validation


def test_exports(spark):
    cues = spark.createDataFrame([(1, 0, 0, 2200, " Hola ", "Persona 1"), (1, 1, 3723004, 3724000, "y  adiós", None)], "source_id long, place long, start_ms long, end_ms long, text string, speaker string")
    assert exports.srt(cues).first().text == "1\n00:00:00,000 --> 00:00:02,200\nPersona 1: Hola\n\n2\n01:02:03,004 --> 01:02:04,000\ny adiós\n"
    assert exports.vtt(cues).first().text == "WEBVTT\n\n00:00:00.000 --> 00:00:02.200\nPersona 1: Hola\n\n01:02:03.004 --> 01:02:04.000\ny adiós\n"
    blocks = spark.createDataFrame([(1, 0, 1000, "Ana", "uno", True), (1, 1, 61000, None, "dos ", False)], "source_id long, block int, start_ms long, speaker string, text string, review_required boolean")
    assert exports.txt(blocks).first().text == "[00:00:01] Ana [REVISAR]\nuno\n\n[00:01:01]\ndos\n"
    assert exports.txt(blocks, with_times=False).first().text == "Ana [REVISAR]\nuno\n\ndos\n"
    files = spark.createDataFrame([(1, "/x/a.wav", "small", "", 600000, 120000), (2, "b.wav", "medium", "es", 0, 0)], "source_id long, file string, model string, language string, audio_ms long, processing_ms long")
    found = {r.source_id: r.text for r in exports.markdown(blocks, files).collect()}
    assert found[1].startswith("# Transcripción: a.wav\n\n- **Modelo:** small\n- **Idioma:** auto\n- **Duración:** 00:10:00\n- **Procesamiento:** 00:02:00\n- **Velocidad:** 5.00× tiempo real\n\n## Transcripción\n\n### [00:00:01] · **Ana** · ⚠ **REVISAR**\n\nuno\n")
    assert found[2].endswith("0.00× tiempo real\n\n## Transcripción\n")


def test_snapshot_of_counts(spark):
    rows = [(1, 8, 9, [0, 1, 2, 3, 4, 5, 6, 7, 8, 10], [0, 1, 2, 3, 4, 6, 7, 8, 10]), (2, 0, 0, None, [3]), (3, None, 4, [1, 2, 3, 4], [1, 9])]
    found = {r.source_id: r for r in validation.snapshot(spark.createDataFrame(rows, "source_id long, raw int, engine int, identity_ids array<int>, assigned_ids array<int>")).collect()}
    a = found[1]
    assert (a.raw_acoustic_clusters, a.engine_identity_clusters, a.identity_consistency_clusters, a.identity_clusters_after_refinement, a.text_assigned_speakers) == (8, 9, 10, 10, 9)
    assert (a.unassigned_raw_ids, a.unassigned_acoustic_clusters, a.identity_count_mismatch, a.text_ids_missing_from_identity_audit) == ([5], 1, True, [])
    assert (found[2].raw_acoustic_clusters, found[2].identity_clusters_after_refinement, found[2].identity_count_mismatch, found[2].text_ids_missing_from_identity_audit) == (0, 0, False, [])
    assert (found[3].raw_acoustic_clusters, found[3].unassigned_raw_ids, found[3].text_ids_missing_from_identity_audit, found[3].identity_count_mismatch) == (4, [2, 3, 4], [9], False)


def test_validation_of_counts(spark):
    rows = [
        (1, 3, 0.1, False, 0, None, "alta", "estimacion_acustica_estable", False), (2, 3, 0.1, True, 4, None, "alta", "estimacion_inestable", True), (3, 3, 2.0, False, 0, None, "alta", "estimacion_sospechosa", True),
        (4, 3, 0.1, True, 3, None, "alta", "estimacion_estable_tras_reintento", False), (5, 0, 0.0, False, 0, None, "alta", "sin_estimacion", False), (6, 3, 9.0, True, 9, 2, "baja", "conteo_fijado_por_usuario", False),
        (7, 3, 0.1, False, 0, None, "baja", "estimacion_sospechosa_identidad", True), (8, 3, 0.1, True, 1, None, "media", "estimacion_con_reservas_identidad", True), (9, 3, 0.1, False, 0, None, None, "estimacion_con_reservas_identidad", True),
        (10, 3, 5.0, False, 0, None, "media", "estimacion_sospechosa", True), (11, 0, 0.0, False, 0, None, "sin_datos", "sin_estimacion", False),
    ]
    df = spark.createDataFrame(rows, "id long, speakers long, penalty double, retry boolean, delta long, manual int, confidence string, want string, doubtful boolean")
    for r in validation.validated(df).collect():
        assert (r.status, r.ambiguous) == (r.want, r.doubtful), r.id
    label = {r.id: r.label for r in validation.validated(df).collect()}
    assert label[1] == "confianza estructural alta" and label[4] == "confianza media" and label[5] == "confianza no determinada" and label[6] == "conteo fijado por usuario" and label[8] == "resultado ambiguo; revisar hablantes"


def test_timers_and_numbers(spark):
    log = "x OfflineSpeakerDiarization: segmentation 1.25 s\nOfflineSpeakerDiarization: embedding 2.5 s\nOfflineSpeakerDiarization:  clustering 0.125 s\nOfflineSpeakerDiarization: total 3.9 s, audio 10.0 s, RTF 0.39"
    df = spark.createDataFrame([(log,), (None,), ("OfflineSpeakerDiarization: embedding 1 s OfflineSpeakerDiarization: EMBEDDING 7 s",)], "log string")
    rows = df.select(*(scalars.timer(F.col("log"), n).alias(n) for n in scalars.TIMERS)).collect()
    assert tuple(rows[0]) == (1.25, 2.5, 0.125, 3.9, 0.39) and tuple(rows[1]) == (None,) * 5 and rows[2].embedding_seconds == 7.0
    texts = spark.createDataFrame([("1.5",), ("-2",), ("x",), (None,), ("NaN",), ("Infinity",)], "v string")
    assert [r[0] for r in texts.select(scalars.number(F.col("v"))).collect()] == [1.5, 0, 0, 0, 0, 0]


def test_overlap_of_turns(spark):
    turns = spark.createDataFrame([(1, 0, 0, 1000, 1), (1, 1, 500, 2000, 2), (1, 2, 3000, 4000, 1), (1, 3, 0, 100_000, 3), (1, 4, 5, 5, 9)], "source_id long, turn_index long, start_ms long, end_ms long, raw_speaker int")
    found = {r.turn_index: r.overlap_ratio for r in intervals.overlap_ratio(turns).collect()}
    assert found == {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.035}
    assert {r.turn_index: r.overlap_ratio for r in intervals.overlap_ratio(turns.where("turn_index < 3")).collect()} == {0: 0.5, 1: round(1 / 3, 6), 2: 0.0}


def test_local_scan_cuts_out_another_voice(spark):
    from turnwise.operators import local_scan

    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    turns = [(0, 0.0, 25000.0, 0, None), (1, 30000.0, 34000.0, 1, b), (2, 36000.0, 40000.0, 1, b), (3, 41000.0, 45000.0, 0, a), (4, 50000.0, 80000.0, 0, None)]

    def spots(voice, n):
        return [(s, i, k, x + (y - x - 2500) * k / (n - 1), x + (y - x - 2500) * k / (n - 1) + 2500, voice(s, x + (y - x - 2500) * k / (n - 1) + 1250)) for s in (1, 2) for i, x, y in ((0, 0.0, 25000.0), (4, 50000.0, 80000.0)) for k in range(n)]

    # Source 1: the known voice b between 9 and 17 s. Source 2: a voice that nobody has, there.
    voice = lambda s, t: (b if s == 1 else c) if 9000 <= t <= 17000 else a
    schema = "source_id long, turn_index long, k int, start_ms double, end_ms double, embedding array<double>"
    df = spark.createDataFrame([(s, *t) for s in (1, 2) for t in turns], "source_id long, turn_index long, start_ms double, end_ms double, speaker int, embedding array<double>")
    found = local_scan.local_change_scan(df, spark.createDataFrame(spots(voice, 3), schema), spark.createDataFrame(spots(voice, 6), schema)).collect()
    for source, target, kind in ((1, 1, "moved"), (2, 2, "new")):
        rows = sorted((r.start_ms, r.end_ms, r.speaker, r.change) for r in found if r.source_id == source)
        assert rows == [(0.0, 9000.0, 0, None), (9000.0, 16000.0, target, kind), (16000.0, 25000.0, 0, None), (30000.0, 34000.0, 1, None), (36000.0, 40000.0, 1, None), (41000.0, 45000.0, 0, None), (50000.0, 80000.0, 0, None)]


def test_text_of_words_and_timed_words(spark):
    rows = [([" Hola", " mundo"],), (["Hola", "mundo"],), (["uno"],), ([" a", "b", "  c "],), ([],), (["ab", None, "cd"],)]
    df = spark.createDataFrame(rows, "tokens array<string>")
    assert [r[0] for r in df.select(scalars.word_text(F.col("tokens"))).collect()] == ["Hola mundo", "Hola mundo", "uno", "ab c", "", "ab cd"]
    words = spark.createDataFrame([([("a", 0, 5), ("b", None, 7), ("c", 7, None), ("d", 7, 9)],)], "words array<struct<word: string, start_ms: long, end_ms: long>>")
    assert [w.word for w in words.select(scalars.timed_words(F.col("words")).alias("w")).first().w] == ["a", "d"]


def test_files_inside_folders(spark):
    files = spark.createDataFrame([(1, "/tmp/a/x.wav"), (2, "/tmp/ab/x.wav"), (3, "/tmp/a"), (4, None), (5, "/tmp/a/b/c.mp3"), (6, "x.wav")], "id long, path string")
    folders = spark.createDataFrame([("/tmp/a/",), ("/tmp/a",), (None,), ("/",)], "folder string")
    assert sorted(r.id for r in scalars.inside(files, folders).collect()) == [1, 3, 5]


def test_progress_of_segments(spark):
    from turnwise.streaming import streams

    segments = spark.createDataFrame([(1, 0, 0, 5, "a"), (1, 1, 5, 12, "b"), (2, 0, 0, 5, "c"), (3, 0, 0, 1, "d")], "source_id long, seg_id long, start_ms long, end_ms long, text string")
    durations = spark.createDataFrame([(1, 10), (2, 0)], "source_id long, duration_ms long")
    assert sorted((r.source_id, r.seg_id, r.percent) for r in streams.progress(segments, durations).collect()) == [(1, 0, 50.0), (1, 1, 100.0), (2, 0, None), (3, 0, None)]
