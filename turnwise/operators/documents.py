"""Documents of jobs: layered JSON of version 8, revisions, report rows, and files of all formats.

A job is a row: source_id, file, model, language, profile, glossary, created_at and any columns of METRICS; columns that aren't there
count as null. Open values are structs, arrays, maps, variants or JSON text, and count as empty objects where they are null."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from turnwise.functions.scalars import clean_text, number
from turnwise.operators import candidates, exports, validation
from turnwise.operators.blocks import BLOCKS_CTE, reading_blocks
from turnwise.operators.identity import _OVERALL, _Dialect
from turnwise.operators.names import unique_names
from turnwise.plans.query import over
from turnwise.plans.shared import place, written
from turnwise.sources import views
from turnwise.sources.files import read_files, write_files

#: The names of a job's measures.
METRICS = (
    dict.fromkeys("audio_seconds asr_seconds diarization_seconds export_seconds overhead_seconds model_load_seconds report_generation_seconds auto_threshold window_shift_ratio diarization_model_prepare_seconds diarization_engine_init_seconds diarization_clustering_config_seconds diarization_decode_seconds diarization_reduction_seconds diarization_process_wall_seconds diarization_time_budget_seconds identity_wall_seconds identity_embedding_compute_seconds".split(), "double")
    | dict.fromkeys("device compute_type speaker_mode diarization_profile auto_selection_reason auto_retry_reason global_profile".split(), "string")
    | dict.fromkeys("batch_size beam_size speaker_requested speaker_detected speaker_text_assigned diarization_threads auto_passes auto_stability_delta_speakers auto_initial_speakers diarization_worker_job_index identity_embedding_calls".split(), "long")
    | dict.fromkeys("batched diarization_enabled auto_retry word_timestamps_forced_for_diarization diarization_models_reused diarization_engine_reused sherpa_internal_timing_available auto_retry_requested auto_retry_avoided auto_retry_skipped_budget".split(), "boolean")
    | dict.fromkeys("speech_region_reduction auto_pilot auto_selected_analysis auto_candidates sherpa_internal sherpa_pass_timings speaker_count_validation speaker_alignment identity_verification identity_refinement identity_local_scan identity_consistency speaker_counts auto_precheck identity_aware_selection".split(), "variant")
)
_STAGES = "asr_seconds diarization_seconds export_seconds overhead_seconds model_load_seconds report_generation_seconds".split()
_KEEP_NULLS = {"ignoreNullFields": "false"}


def closed(jobs: DataFrame) -> DataFrame:
    """jobs with every column of METRICS, times of at least 0, and processing_seconds, end_to_end_seconds, rtf, speed_x and performance."""
    have = dict(jobs.dtypes)
    columns = {}
    for name, kind in METRICS.items():
        if name not in have or have[name] == "void":
            columns[name] = F.lit(None).cast(kind)
        elif kind == "variant":
            column = F.col(name)
            columns[name] = column if have[name] == "variant" else F.try_parse_json(column if have[name] == "string" else F.to_json(column, _KEEP_NULLS))
        else:
            columns[name] = F.col(name).cast(kind)
    out = jobs.withColumns(columns).withColumns({c: number(F.col(c)) for c in _STAGES})
    audio = number(F.col("audio_seconds"))
    out = out.withColumn("processing_seconds", F.col("asr_seconds") + F.col("diarization_seconds") + F.col("export_seconds") + F.col("overhead_seconds"))
    work = F.col("processing_seconds")
    out = out.withColumns({"end_to_end_seconds": F.col("model_load_seconds") + work + F.col("report_generation_seconds"), "rtf": F.when(audio > 0, work / audio), "speed_x": F.when(work > 0, audio / work)})
    whole = F.col("end_to_end_seconds")
    share = lambda c: F.when(work > 0, F.col(c) / work).otherwise(0.0)
    real = [F.lit("processing_seconds <= audio_seconds").alias("target"), (work <= audio).alias("within_realtime"), (work / audio).alias("processing_to_audio"), share("asr_seconds").alias("asr_share"), share("diarization_seconds").alias("diarization_share"), F.greatest(F.lit(0.0), work - audio).alias("seconds_over_realtime")]
    end = [whole.alias("end_to_end_seconds"), (whole / audio).alias("end_to_end_to_audio"), (whole <= audio).alias("end_to_end_within_realtime"), F.greatest(F.lit(0.0), whole - audio).alias("end_to_end_seconds_over_realtime")]
    unknown = F.struct(F.lit("unknown").alias("target"), F.lit(None).cast("boolean").alias("within_realtime"))
    text = F.when(audio <= 0, F.to_json(unknown, _KEEP_NULLS)).when(whole > 0, F.to_json(F.struct(*real, *end))).otherwise(F.to_json(F.struct(*real)))
    return out.withColumn("performance", F.parse_json(text))


def _open(name: str, empty: str = "{}") -> Column:
    """An open value, or an empty one where it is null."""
    return F.when(F.is_variant_null(name), F.parse_json(F.lit(empty))).otherwise(F.coalesce(name, F.parse_json(F.lit(empty))))


def _flag(name: str) -> Column:
    return F.coalesce(name, F.lit(False))


def _or(name: str, value) -> Column:
    return F.coalesce(name, F.lit(value))


def file_name(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/\\]*)$", 1)


def stem(file: Column) -> Column:
    """The name of a file without its last extension; a name that starts with its only dot has none."""
    return F.regexp_replace(file_name(file), r"(?<=.)\.[^.]+$", "")


def hotwords(glossary: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(glossary, F.lit("")), r"[,;\n]+"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


#: Layers of a document: each adds to what stands below it, or puts its own in its place.


def _base(doc: dict, edited: Column) -> dict:
    names = [*METRICS, "processing_seconds", "end_to_end_seconds", "rtf", "speed_x", "performance"]
    flagged = F.size(F.filter("reading_blocks", lambda b: F.coalesce(b["review_required"], F.lit(False))))
    return {
        "source": file_name(F.col("file")), "model": F.col("model"), "language": F.when(_or("language", "") != "", F.col("language")).otherwise("auto"), "created_at": F.col("created_at"), "profile": F.col("profile"), "hotwords": hotwords(F.col("glossary")), "text": F.col("text"),
        "metrics": {n: F.col(n) for n in names}, "segments": F.col("segments"), "reading_blocks": F.col("reading_blocks"), "speakers": F.col("speakers"), "review": {"status": F.lit("machine_generated"), "edited": edited, "flagged_blocks": flagged},
    }


def _timed(doc: dict) -> dict:
    plain = {n: F.col(n) for n in "device compute_type batch_size beam_size speaker_requested auto_threshold speech_region_reduction diarization_threads auto_retry".split()}
    own = {"profile": F.col("profile"), "batched": _flag("batched"), "diarization_enabled": _flag("diarization_enabled"), "speaker_mode": _or("speaker_mode", "No"), "speaker_detected": _or("speaker_detected", 0)}
    timing = {n: F.col(n) for n in "model_load_seconds asr_seconds diarization_seconds export_seconds overhead_seconds report_generation_seconds processing_seconds end_to_end_seconds rtf speed_x".split()}
    voices = {
        "enabled": _flag("diarization_enabled"), "mode": _or("speaker_mode", "No"), "requested_speakers": F.col("speaker_requested"), "detected_speakers": _or("speaker_detected", 0), "selected_threshold": F.col("auto_threshold"), "pilot": F.col("auto_pilot"),
        "speech_region_reduction": F.col("speech_region_reduction"), "diarization_threads": F.col("diarization_threads"), "auto_retry": F.col("auto_retry"), "initial_speakers": F.col("auto_initial_speakers"),
    }
    return doc | {"configuration": own | plain, "timing": timing, "diarization": voices}


def _passes(doc: dict) -> dict:
    both = {"window_shift_ratio": F.col("window_shift_ratio")}
    own = {
        "profile": F.col("diarization_profile"), "passes": _or("auto_passes", 1), "selection_reason": F.col("auto_selection_reason"), "retry_reason": F.col("auto_retry_reason"), "stability_delta_speakers": F.col("auto_stability_delta_speakers"),
        "selected_analysis": F.col("auto_selected_analysis"), "candidates": _open("auto_candidates", "[]"),
    }
    return doc | {"configuration": doc["configuration"] | {"diarization_profile": F.col("diarization_profile")} | both, "diarization": doc["diarization"] | own | both}


def _aligned(doc: dict) -> dict:
    seconds = "model_prepare engine_init clustering_config decode reduction process_wall".split()
    timing = {f"{n}_seconds": _or(f"diarization_{n}_seconds", 0.0) for n in seconds}
    timing |= {"internal_available": _flag("sherpa_internal_timing_available"), "sherpa_internal": _open("sherpa_internal"), "passes": _open("sherpa_pass_timings", "[]")}
    worker = {"job_index": F.col("diarization_worker_job_index"), "models_reused": F.col("diarization_models_reused"), "engine_reused": F.col("diarization_engine_reused")}
    forced = {"word_timestamps_forced_for_diarization": _flag("word_timestamps_forced_for_diarization")}
    own = {"persistent_worker": worker, "timing": timing, "speaker_count_validation": _open("speaker_count_validation")}
    return doc | {"configuration": doc["configuration"] | forced, "diarization": doc["diarization"] | own, "alignment": _open("speaker_alignment")}


def _identities(doc: dict) -> dict:
    names = {"identity_verification": "identity_verification", "identity_refinement": "identity_refinement", "local_change_scan": "identity_local_scan", "identity_consistency": "identity_consistency"}
    return doc | {"diarization": doc["diarization"] | {k: _open(v) for k, v in names.items()}}


def _counted(doc: dict) -> dict:
    own = {n: _open(n) for n in ("speaker_counts", "auto_precheck", "identity_aware_selection")}
    own |= {"retry_requested": _flag("auto_retry_requested"), "retry_avoided": _flag("auto_retry_avoided"), "retry_skipped_budget": _flag("auto_retry_skipped_budget"), "time_budget_seconds": F.col("diarization_time_budget_seconds")}
    return doc | {"diarization": doc["diarization"] | own, "performance": F.col("performance"), "global_profile": F.col("global_profile")}


#: The version that each layer stands for.
LAYERS = ((3, _timed), (4, _passes), (5, _aligned), (6, _identities), (8, _counted))


def _nested(doc: dict) -> Column:
    return F.struct(*((_nested(v) if isinstance(v, dict) else v).alias(k) for k, v in doc.items()))


def documents(jobs: DataFrame, segments: DataFrame, blocks: DataFrame, version: int = 8, edited: bool = False) -> DataFrame:
    """source_id, document: one JSON text a job, of the layers up to `version`.

    segments: source_id, place, start_ms, end_ms, text, speaker (a name or null) and any further columns. blocks: source_id, block,
    start_ms, end_ms, speaker, text, segment_ids, review_required. Speakers come from the segments in the order of their first one.
    Sources without segments or blocks have empty lists."""
    seconds = lambda c: (F.col(c) / 1000.0).alias(c[:-3])
    more = [c for c in segments.columns if c not in ("source_id", "place", "start_ms", "end_ms", "text", "speaker")]
    listed = lambda df, name, order, *columns: df.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("id"), *columns))).alias(name))
    own = listed(segments, "segments", "place", seconds("start_ms"), seconds("end_ms"), clean_text(F.col("text")).alias("text"), "speaker", *more)
    read = listed(blocks, "reading_blocks", "block", seconds("start_ms"), seconds("end_ms"), "speaker", "text", F.transform(F.split("segment_ids", ","), lambda x: x.cast("long")).alias("segment_ids"), "review_required")
    named = segments.where("speaker IS NOT NULL").groupBy("source_id", "speaker").agg(F.min("place").alias("first"), F.count("*").alias("segments"), F.sum((F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("seconds"))
    voices = named.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("first", F.col("speaker").alias("display_name"), "segments", "seconds"))).alias("_v"))
    voices = voices.select("source_id", F.transform("_v", lambda x: F.struct(x["display_name"].alias("display_name"), x["segments"].alias("segments"), F.round(x["seconds"], 3).alias("seconds"))).alias("speakers"))
    held = closed(jobs).drop("segments", "reading_blocks", "speakers", "text")
    for other in (own, read, voices):
        held = held.join(other, "source_id", "left")
    held = held.withColumns({n: F.coalesce(n, F.array().cast(held.schema[n].dataType)) for n in ("segments", "reading_blocks", "speakers")})
    held = held.withColumn("text", F.array_join(F.filter(F.transform("segments", lambda s: s["text"]), lambda t: t != ""), " "))
    doc, number_ = _base({}, F.lit(edited)), F.lit(2)
    for at, layer in LAYERS:
        if at <= version:
            doc, number_ = layer(doc), F.greatest(F.lit(at), number_)
    return held.select("source_id", F.to_json(_nested({"schema_version": number_} | doc), _KEEP_NULLS).alias("document"))


@F.pandas_udf(StringType())
def indented(document: pd.Series) -> pd.Series:
    """Compact JSON with an indent of 2, letters beyond ASCII as they are, and a line end behind it."""
    return document.map(lambda d: None if d is None else json.dumps(json.loads(d), ensure_ascii=False, indent=2) + "\n")


def read_documents(files: DataFrame) -> DataFrame:
    """files with doc (a variant) and status in the place of text: ok, missing (no text or only blanks), or corrupt (no JSON object
    with a schema_version). Only ok rows have a doc."""
    v = F.try_parse_json("text")
    held = files.drop("status", "doc").withColumn("_v", F.when(F.schema_of_variant(v).startswith("OBJECT"), v))
    status = F.when(~F.coalesce("text", F.lit("")).rlike(r"\S"), "missing").when(F.try_variant_get("_v", "$.schema_version", "int").isNull(), "corrupt").otherwise("ok")
    return held.withColumn("status", status).withColumn("doc", F.when(F.col("status") == "ok", F.col("_v"))).drop("text", "_v")


def renamed(df: DataFrame, renames: DataFrame) -> DataFrame:
    """df (source_id, speaker, ...) with the names that renames (source_id, old, new) give; blank and null new names change nothing,
    and of several for one name the least counts."""
    names = renames.select("source_id", F.col("old").alias("speaker"), F.trim("new").alias("_new")).where("_new <> ''").groupBy("source_id", "speaker").agg(F.min("_new").alias("_new"))
    joined = df.join(names, ["source_id", "speaker"], "left").withColumn("speaker", F.coalesce("_new", "speaker"))
    return joined.select(*df.columns)


def formats(jobs: DataFrame, segments: DataFrame, blocks: DataFrame, documents_: DataFrame) -> DataFrame:
    """source_id, stem, txt, md, srt, vtt, json: the texts of all formats of a job."""
    files = closed(jobs).select("source_id", "file", "model", "language", F.round(number(F.col("audio_seconds")) * 1000).cast("long").alias("audio_ms"), F.round(F.col("processing_seconds") * 1000).cast("long").alias("processing_ms"))
    out = jobs.select("source_id", stem(F.col("file")).alias("stem"))
    parts = {"txt": exports.txt(blocks), "md": exports.markdown(blocks, files), "srt": exports.srt(segments), "vtt": exports.vtt(segments), "json": documents_.select("source_id", indented("document").alias("text"))}
    empty = {"txt": "\n", "srt": "", "vtt": "WEBVTT\n"}
    for name, df in parts.items():
        out = out.join(df.select("source_id", F.col("text").alias(name)), "source_id", "left").withColumn(name, F.coalesce(name, F.lit(empty.get(name))))
    return out


def _as_files(wide: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return wide.select("source_id", F.explode(F.array(*(F.struct(F.concat("stem", F.lit(f".{k}")).alias("name"), F.col(k).alias("text")) for k in kinds))).alias("f")).select("source_id", "f.*")


def unique_stems(jobs: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """jobs with stem replaced by a name of its own, in the order of source_id; taken (name): stems that are given already."""
    return unique_names(jobs, "source_id", taken).drop("stem").withColumnRenamed("name", "stem")


def revision(jobs: DataFrame, segments: DataFrame, blocks: DataFrame, renames: DataFrame, stamp: str) -> DataFrame:
    """source_id, name, text of the files of an edited revision: TXT, Markdown and a base document that is marked as edited, with new
    names of speakers in blocks, segments and speakers. stamp: the time in the names, as YYYYMMDD_HHMMSS."""
    segments, blocks = renamed(segments, renames), renamed(blocks, renames)
    wide = formats(jobs, segments, blocks, documents(jobs, segments, blocks, version=2, edited=True))
    return _as_files(unique_stems(wide.withColumn("stem", F.concat("stem", F.lit(f"_revision_{stamp}")))), ("txt", "md", "json"))


# Report rows


def fixed(x: Column, places: int = 2) -> Column:
    """A number with so many places, halves to even."""
    return F.call_function("format_number", x, F.lit("0." + "0" * places))


def clock(seconds: Column) -> Column:
    t = F.floor(F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0))).cast("long")
    two = lambda x: F.when(x < 100, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    return F.concat(two(F.floor(t / 3600)), F.lit(":"), two(F.floor(t / 60) % 60), F.lit(":"), two(t % 60))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _int(v: Column, path: str, default: int = 0) -> Column:
    return F.coalesce(_get(v, path, "bigint"), F.lit(default)).cast("string")


def _seconds(x: Column) -> Column:
    return F.concat(fixed(F.coalesce(x, F.lit(0.0))), F.lit(" s"))


def _open_seconds(v: Column, path: str) -> Column:
    """As _seconds, and a dash for what is there but is no number."""
    x, raw = _get(v, path, "double"), _get(v, path, "string")
    return F.when(x.isNull() & raw.isNotNull(), F.lit("—")).otherwise(_seconds(x))


def identity_sentence(v: Column) -> Column:
    """What is said about an identity, a variant with confidence, turns, embedded_turns, total_seconds, max_gap_seconds and similarities."""
    n = F.coalesce(_get(v, "embedded_turns", "bigint"), F.lit(0))
    gap = F.coalesce(_get(v, "max_gap_seconds", "double"), F.lit(0.0))
    base = F.concat(
        F.coalesce(_get(v, "confidence", "string"), F.lit("sin_datos")), F.lit(" · "), _int(v, "turns"), F.lit(" turno(s) · "), fixed(F.coalesce(_get(v, "total_seconds", "double"), F.lit(0.0)), 1), F.lit(" s · "), n.cast("string"), F.lit(" muestra(s) acústica(s)")
    )
    part = lambda text, name: F.when(_get(v, name, "double").isNotNull(), F.concat(F.lit(f" · {text} "), fixed(_get(v, name, "double")))).otherwise(F.lit(""))
    rival = part("rival máx", "rival_similarity_max")
    apart = F.when(gap > 0, F.concat(F.lit(" · separación máx "), fixed(gap, 1), F.lit(" s"))).otherwise(F.lit(""))
    tail = F.when(n == 0, " · similitud no evaluable").when(n == 1, " · muestra única; similitud no evaluable").when(n == 2, F.concat(part("similitud entre apariciones", "pair_similarity"), rival, apart)).otherwise(F.concat(part("prototipo mediana", "prototype_similarity_median"), part("mínimo", "prototype_similarity_min"), rival))
    return F.concat(base, tail)


def _validity(v: Column) -> Column:
    status = _get(v, "status", "string")
    return (
        F.when(F.coalesce(_get(v, "ambiguous", "boolean"), F.lit(False)), "resultado ambiguo; revisar hablantes").when(status.isin("estimacion_sospechosa", "estimacion_inestable", "estimacion_sospechosa_identidad"), "baja confianza")
        .when(status.isin("estimacion_con_reservas_identidad", "estimacion_estable_tras_reintento"), "confianza media").when(status == "estimacion_acustica_estable", "confianza estructural alta").when(status == "conteo_fijado_por_usuario", "conteo fijado por usuario").otherwise("confianza no determinada")
    )


def report(jobs: DataFrame) -> DataFrame:
    """source_id, place, label, value: the rows of a job's report in order, those that don't apply left out."""
    m = closed(jobs)
    t = lambda c: F.col(c).cast("string")
    dash = lambda c: F.coalesce(F.when(t(c) != "", t(c)), F.lit("—"))
    yes = lambda c: F.when(_flag(c), "Sí").otherwise("No")
    counts, valid, internal = _open("speaker_counts"), _open("speaker_count_validation"), _open("sherpa_internal")
    align, refinement, scan, consistency, verified = (_open(c) for c in ("speaker_alignment", "identity_refinement", "identity_local_scan", "identity_consistency", "identity_verification"))
    pre, sel, perf = _open("auto_precheck"), _open("identity_aware_selection"), F.col("performance")
    acoustic = F.coalesce(_get(counts, "raw_acoustic_clusters", "bigint"), "speaker_detected", F.lit(0)).cast("string")
    identities = F.coalesce(_get(counts, "identity_clusters_after_refinement", "bigint").cast("string"), acoustic)
    texts = F.coalesce(_get(counts, "text_assigned_speakers", "bigint"), "speaker_text_assigned", F.lit(0)).cast("string")
    loose = F.array_sort(F.array_distinct(F.coalesce(_get(counts, "unassigned_raw_ids", "array<bigint>"), F.array().cast("array<bigint>"))))
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    device = F.when(_or("device", "") != "", F.concat("device", F.when(_or("compute_type", "") != "", F.concat(F.lit(" / "), "compute_type")).otherwise(""))).otherwise("—")
    speakers = F.when(~_flag("diarization_enabled"), "No").when(F.col("speaker_mode") == "Auto", join("Auto · estimación acústica: ", identities, " · con texto: ", texts, " · ", _validity(valid))).otherwise(join("Solicitados: ", F.coalesce(t("speaker_requested"), F.lit("None")), " · acústicos: ", identities, " · con texto: ", texts))
    some = lambda v: F.schema_of_variant(v) != "OBJECT<>"
    on = lambda v, name="enabled": F.coalesce(_get(v, name, "boolean"), F.lit(False))
    has = lambda v, name: _get(v, name, "variant").isNotNull()
    timing = F.col("sherpa_internal_timing_available")
    rows: list[tuple] = [
        ("Archivo", file_name(F.col("file"))), ("Modelo", F.col("model")), ("Idioma", F.when(_or("language", "") != "", F.col("language")).otherwise("auto")), ("Perfil ASR", F.col("profile")), ("Backend", device),
        ("Batch", F.when(_flag("batched"), F.coalesce(t("batch_size"), F.lit("None"))).otherwise("secuencial")), ("Beam", dash("beam_size")), ("Hablantes", speakers), ("Perfil diarización", dash("diarization_profile")),
        ("Window shift", F.coalesce(fixed(F.col("window_shift_ratio")), F.lit("—"))), ("Hilos diarización", F.when(_or("diarization_threads", 0) != 0, t("diarization_threads")).otherwise("—")), ("Pasadas Auto", F.when(_or("auto_passes", 0) != 0, t("auto_passes")).otherwise("1")),
        ("Selección Auto", dash("auto_selection_reason")), ("Duración", clock(F.col("audio_seconds"))), ("Carga de modelo", clock(F.col("model_load_seconds"))), ("Transcripción ASR", clock(F.col("asr_seconds"))), ("Identificación hablantes", clock(F.col("diarization_seconds"))),
        ("Exportación", clock(F.col("export_seconds"))), ("Otros", clock(F.col("overhead_seconds"))), ("Procesamiento", clock(F.round("processing_seconds", 6))), ("Espera extremo a extremo", clock(F.round("end_to_end_seconds", 6))), ("Velocidad", join(fixed(_or("speed_x", 0.0)), "× tiempo real")),
        ("Auto hablantes", join("umbral elegido ", fixed(F.col("auto_threshold"))), F.col("auto_threshold").isNotNull()), ("Motivo segunda pasada", F.col("auto_retry_reason"), _or("auto_retry_reason", "") != ""),
        ("Alineación hablantes", join(F.coalesce(_get(align, "mode", "string"), F.lit("—")), " · ", _int(align, "split_source_segments"), " segmento(s) divididos · ", _int(align, "speaker_switches_inside_segments"), " cambio(s) interno(s)")),
        ("Timestamps palabra internos", yes("word_timestamps_forced_for_diarization")),
        ("Worker diarización", join("persistente · job ", F.when(_or("diarization_worker_job_index", 0) != 0, t("diarization_worker_job_index")).otherwise("—"), " · motor ", F.when(_flag("diarization_engine_reused"), "reutilizado").otherwise("inicializado"))),
        ("Preparación modelos diar.", _seconds(F.col("diarization_model_prepare_seconds"))), ("Inicialización motor diar.", _seconds(F.col("diarization_engine_init_seconds"))), ("Decodificación diar.", _seconds(F.col("diarization_decode_seconds"))), ("Proceso sherpa (wall)", _seconds(F.col("diarization_process_wall_seconds"))),
        *((f"Sherpa {label}", _open_seconds(internal, name), F.coalesce(timing, F.lit(False))) for label, name in (("segmentación", "segmentation_seconds"), ("embeddings", "embedding_seconds"), ("clustering", "clustering_seconds"), ("total interno", "sherpa_total_seconds"))),
        ("Timers internos sherpa", F.lit("no capturados por el backend/SO; se conserva medición wall"), ~F.coalesce(timing, F.lit(False))),
        ("Validación conteo hablantes", join(F.coalesce(_get(valid, "status", "string"), F.lit("—")), " · acústicos ", identities, " · con texto ", texts, " · ground truth ", F.when(on(valid, "ground_truth_available"), "sí").otherwise("no"), " · identidad ", F.coalesce(_get(valid, "identity_confidence", "string"), F.lit("sin_datos"))), some(valid)),
        (F.transform(F.coalesce(_open("sherpa_pass_timings", "[]").cast("array<variant>"), F.array().cast("array<variant>")), lambda p: F.struct(join("Sherpa pasada ", _int(p, "pass"), " (wall)").alias("label"), _open_seconds(p, "process_wall_seconds").alias("value"))),),
        ("Control identidad V5.2", F.lit("Sí · control acústico conservador y selección identity-aware"), on(verified)), ("Identidad total (wall)", F.when(has(verified, "total_wall_seconds"), _open_seconds(verified, "total_wall_seconds")).otherwise(_seconds(F.col("identity_wall_seconds"))), on(verified)),
        ("Embeddings identidad", join(_or("identity_embedding_calls", 0).cast("string"), " cálculo(s) · ", _seconds(F.col("identity_embedding_compute_seconds"))), on(verified)),
        ("Refinamiento identidad", join(_int(refinement, "reassigned_turns"), " turno(s) reasignado(s) · ", _int(refinement, "new_identities"), " identidad(es) nueva(s)"), on(verified)),
        ("Escaneo local", join(_int(scan, "scanned_turns"), " turno(s) largo(s) · ", _int(scan, "applied_changes"), " cambio(s) aplicado(s)"), on(verified)), ("Consistencia identidad", F.coalesce(_get(consistency, "overall_confidence", "string"), F.lit("sin_datos")), on(verified)),
        ("Identidad etapa final (wall)", _open_seconds(verified, "final_stage_wall_seconds"), on(verified) & has(verified, "final_stage_wall_seconds")), ("Identidad ligera (wall)", _open_seconds(verified, "light_identity_wall_seconds"), on(verified) & has(verified, "light_identity_wall_seconds")),
    ]

    def one(sp: Column) -> Column:
        raw, name = F.coalesce(_get(sp, "speaker", "bigint"), F.lit(-1)), _get(sp, "display_name", "string")
        label = F.when(F.coalesce(name, F.lit("")) != "", join("Identidad ", name)).when(F.array_contains(loose, raw), join("Cluster acústico raw ", raw.cast("string"), " (sin texto)")).otherwise(join("Cluster acústico raw ", raw.cast("string")))
        return F.struct(label.alias("label"), identity_sentence(sp).alias("value"))

    listed = F.when(on(verified), F.coalesce(_get(consistency, "speakers", "array<variant>"), F.array().cast("array<variant>"))).otherwise(F.array().cast("array<variant>"))
    rows += [
        (F.transform(listed, one),),
        ("Rendimiento diarización", F.lit("Precisa prioriza resolución temporal y puede ser muy lenta en CPU; Equilibrada es el perfil recomendado."), (_or("device", "") == "cpu") & (_or("diarization_profile", "") == "Precisa")),
        ("Clusters sherpa seleccionados", acoustic), ("Clusters tras control identidad", identities), ("Hablantes con texto", texts), ("Clusters acústicos sin texto", F.when(F.size(loose) > 0, F.array_join(loose.cast("array<string>"), ", ")).otherwise("0")),
        ("Segunda pasada solicitada", yes("auto_retry_requested")), ("Segunda pasada evitada", yes("auto_retry_avoided")), ("Segunda pasada omitida por presupuesto", yes("auto_retry_skipped_budget")), ("Presupuesto diarización Auto", _seconds(F.col("diarization_time_budget_seconds")), F.col("diarization_time_budget_seconds").isNotNull()),
        ("Precheck rendimiento Auto", join(_open_seconds(pre, "wall_seconds"), " · ", _int(pre, "speakers_before"), "→", _int(pre, "speakers_after"), " · ", F.when(on(pre, "accepted"), "aceptado").otherwise("no concluyente")), on(pre)),
        ("Selección Auto identity-aware", join(F.coalesce(_get(sel, "selected_candidate", "string"), F.lit("—")), " · score 1 ", fixed(F.coalesce(_get(sel, "first_score", "double"), F.lit(0.0))), " · score 2 ", fixed(F.coalesce(_get(sel, "second_score", "double"), F.lit(0.0)))), on(sel)),
        ("Presupuesto de rendimiento", join(F.when(_get(perf, "within_realtime", "boolean"), "cumplido").otherwise("sobre tiempo real"), " · proceso/audio ", fixed(F.coalesce(_get(perf, "processing_to_audio", "double"), F.lit(0.0))), "×"), _get(perf, "within_realtime", "boolean").isNotNull()),
        ("Modo global", F.col("global_profile"), _or("global_profile", "") != ""),
    ]
    parts = []
    for row in rows:
        if len(row) == 1:
            parts.append(row[0])
        else:
            entry = F.struct(F.lit(row[0]).alias("label"), F.coalesce(row[1], F.lit("None")).alias("value"))
            parts.append(F.array(entry) if len(row) == 2 else F.when(F.coalesce(row[2], F.lit(False)), F.array(entry)).otherwise(F.array().cast("array<struct<label:string,value:string>>")))
    return m.select("source_id", F.posexplode(F.concat(*parts)).alias("place", "r")).select("source_id", "place", "r.label", "r.value")


# Queries: the conversations as jobs

_PRESETS = {"Rápido": ("small", "Rapido", "Rápida", 1), "Equilibrado": ("small", "Equilibrado", "Equilibrada", 5), "Preciso": ("medium", "Preciso", "Precisa", 5)}
_OTHER = ("small", "Equilibrado", "Equilibrada", 5)


def _named(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Segments and blocks with names of speakers, numbered in the order of their first segment."""
    segments = views.segments(spark, sf_dir)
    first = segments.groupBy("source_id", "raw_speaker").agg(F.min("seg_id").alias("_f"))
    names = first.select("source_id", "raw_speaker", F.concat(F.lit("Persona "), F.row_number().over(Window.partitionBy("source_id").orderBy("_f")).cast("string")).alias("speaker"))
    own = segments.join(names, ["source_id", "raw_speaker"]).select("source_id", F.col("seg_id").alias("place"), "start_ms", "end_ms", "text", "speaker", "avg_logprob", "no_speech_prob", "compression_ratio", "raw_speaker")
    blocks = reading_blocks(segments).withColumnRenamed("speaker", "raw_speaker").join(names, ["source_id", "raw_speaker"]).drop("raw_speaker")
    return own, blocks


def _jobs(spark, sf_dir) -> DataFrame:
    segments, events = views.segments(spark, sf_dir), views.read(spark, sf_dir, "events")
    sources = segments.groupBy("source_id").agg(F.min_by("text", "seg_id").alias("glossary"))
    m = views.job_metrics(spark, sf_dir).withColumnRenamed("job_id", "source_id")
    seconds = lambda c, n: (F.col(c) / 100.0).alias(n)
    timers = F.struct(seconds("overhead_cs", "segmentation_seconds"), seconds("export_cs", "embedding_seconds"), seconds("diarization_cs", "sherpa_total_seconds"))
    times = m.select("source_id", *(seconds(f"{c}_cs", f"{c}_seconds") for c in ("audio", "model_load", "asr", "diarization", "export", "overhead")), timers.alias("sherpa_internal"))
    when = events.groupBy(F.col("user_id").alias("source_id")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))
    counts = validation.snapshots(spark, sf_dir).select("source_id", F.struct("raw_acoustic_clusters", "identity_clusters_after_refinement", "text_assigned_speakers", "unassigned_raw_ids").alias("speaker_counts"))
    found = candidates._passes(spark, sf_dir)
    passes = found.select(
        "source_id", F.col("candidates").alias("auto_candidates"), F.col("selection_reason").alias("auto_selection_reason"), F.col("reason").alias("auto_retry_reason"), F.size("candidates").alias("auto_passes"), F.col("selected_threshold").alias("auto_threshold"), "auto_precheck",
        "identity_aware_selection", F.col("stability_delta").alias("auto_stability_delta_speakers"), F.col("reason").isNotNull().alias("auto_retry_requested"), F.col("retry_avoided").alias("auto_retry_avoided"), F.col("retry_skipped_budget").alias("auto_retry_skipped_budget"), F.col("budget_s").alias("diarization_time_budget_seconds"),
    )
    d = _Dialect(True)
    look = over(spark, f"WITH {d.summary()}, {_OVERALL}, shown AS (SELECT DISTINCT source_id AS s, raw_speaker AS r, dense_rank() OVER (PARTITION BY source_id ORDER BY f) AS place FROM (SELECT source_id, raw_speaker, min(seg_id) AS f FROM segments GROUP BY source_id, raw_speaker) x) SELECT v.*, o.overall_confidence, place FROM verdict v JOIN overall o ON v.source_id = o.source_id LEFT JOIN shown ON v.source_id = s AND speaker = r", {"turn_embeddings": written(views.sampled_turns(spark, sf_dir), "sampled-turns"), "segments": segments})
    six = lambda c, n: F.round(c, 6).alias(n)
    said = F.struct("speaker", F.concat(F.lit("Persona "), F.col("place").cast("string")).alias("display_name"), "confidence", "turns", "embedded_turns", (F.col("total_ms") / 1000.0).alias("total_seconds"), (F.col("max_gap_ms") / 1000.0).alias("max_gap_seconds"), six("pair", "pair_similarity"), six("own_median", "prototype_similarity_median"), six("own_min", "prototype_similarity_min"), six("rival", "rival_similarity_max"))
    whole = look.groupBy("source_id", "overall_confidence").agg(F.array_sort(F.collect_list(said)).alias("speakers"))
    voices = whole.select("source_id", F.struct("overall_confidence", "speakers").alias("identity_consistency"), F.struct(F.lit(True).alias("enabled")).alias("identity_verification"))
    out = sources
    for other in (candidates.profiles(spark, sf_dir), times, when, counts, passes, voices):
        out = out.join(other, "source_id", "left")
    preset = lambda k: F.coalesce(*(F.when(F.col("global_profile") == n, v[k]) for n, v in _PRESETS.items()), F.lit(_OTHER[k]))
    out = out.withColumn("global_profile", _or("profile", "Personalizado"))
    word = F.lower(F.regexp_extract("glossary", "^[A-Za-z]+", 0))
    return out.withColumns({
        "file": F.concat(F.lit("/audio/"), word, F.lit(".01.wav")), "model": preset(0), "profile": preset(1), "diarization_profile": preset(2), "beam_size": preset(3), "language": F.when(F.col("global_profile") == "Preciso", "es").otherwise(""), "device": F.lit("cpu"), "compute_type": F.lit("int8"),
        "batched": F.col("global_profile") != "Rápido", "batch_size": F.lit(4), "diarization_enabled": F.col("audio_seconds").isNotNull(), "speaker_mode": F.lit("Auto"), "speaker_detected": F.col("speaker_counts.raw_acoustic_clusters"), "sherpa_internal_timing_available": F.col("global_profile") == "Preciso",
    })


def json_document(spark, sf_dir):
    """Documents written as files, one a source, and read back from them."""
    jobs = _jobs(spark, sf_dir)
    segments, blocks = _named(spark, sf_dir)
    made = documents(jobs, segments, blocks).join(unique_stems(jobs.select("source_id", stem(F.col("file")).alias("stem"))), "source_id")
    path = place(spark, "documents")
    write_files(made.select(F.concat("stem", F.lit(".json")).alias("name"), indented("document").alias("text")), path)
    doc = F.col("doc")
    get = lambda p, kind, name=None: _get(doc, p, kind).alias(name or p.split(".")[-1])
    size = lambda p, name: F.size(_get(doc, p, "array<variant>")).cast("long").alias(name)
    six = lambda p: F.round(_get(doc, p, "double"), 6).alias(p.split(".")[-1])
    names = F.array_join(F.transform(_get(doc, "speakers", "array<variant>"), lambda s: F.concat(_get(s, "display_name", "string"), F.lit("="), _get(s, "segments", "string"))), ",")
    return read_documents(read_files(spark, path, "*.json")).select(
        "name", "status", get("schema_version", "int"), get("source", "string"), get("language", "string"), get("created_at", "string"), get("profile", "string"), size("hotwords", "n_hotwords"), get("text", "string"), size("segments", "n_segments"), size("reading_blocks", "n_blocks"), get("review.flagged_blocks", "bigint"), get("review.edited", "boolean"),
        names.alias("speakers"), get("configuration.beam_size", "int"), get("configuration.batched", "boolean"), get("configuration.diarization_profile", "string"), six("timing.processing_seconds"), six("timing.end_to_end_seconds"), six("timing.speed_x"), get("diarization.enabled", "boolean"), get("diarization.detected_speakers", "bigint"), get("diarization.selection_reason", "string"),
        F.coalesce(F.size(_get(doc, "diarization.candidates", "array<variant>")), F.lit(0)).cast("long").alias("n_candidates"), get("diarization.speaker_counts.text_assigned_speakers", "bigint"), get("diarization.identity_consistency.overall_confidence", "string"), get("diarization.retry_skipped_budget", "boolean"), get("performance.target", "string"), get("performance.within_realtime", "boolean"),
        six("performance.seconds_over_realtime"), get("global_profile", "string"),
    )


def export_files(spark, sf_dir):
    """TXT, Markdown, SRT and WebVTT of all sources, written as files under names of their own and read back."""
    jobs = _jobs(spark, sf_dir).select("source_id", "file", "model", "language", "audio_seconds", "asr_seconds", "diarization_seconds", "export_seconds", "overhead_seconds")
    segments, blocks = _named(spark, sf_dir)
    wide = formats(jobs, segments, blocks, jobs.select("source_id", F.lit("{}").alias("document")))
    path = place(spark, "exports")
    write_files(_as_files(unique_stems(wide), ("txt", "md", "srt", "vtt")), path)
    return read_files(spark, path)


def revision_export(spark, sf_dir):
    """Revisions of all sources, written and read back: the speaker of the first segment gets the source's first word as a name. Of
    the documents, what a revision changes."""
    jobs = _jobs(spark, sf_dir)
    segments, blocks = _named(spark, sf_dir)
    renames = segments.where("place = 0").select("source_id", F.col("speaker").alias("old"), F.initcap(F.regexp_extract("text", "^[A-Za-z]+", 0)).alias("new"))
    path = place(spark, "revisions")
    write_files(revision(jobs, segments, blocks, renames, "20240102_030405").drop("source_id"), path)
    doc = F.try_parse_json("text")
    names = lambda p, k: F.array_join(F.array_sort(F.array_distinct(F.transform(_get(doc, p, "array<variant>"), lambda x: _get(x, k, "string")))), ",")
    changed = F.concat_ws("|", _get(doc, "schema_version", "string"), _get(doc, "review.edited", "string"), names("segments", "speaker"), names("reading_blocks", "speaker"), names("speakers", "display_name"), F.coalesce(_get(doc, "configuration", "string"), F.lit("-")))
    return read_files(spark, path).select("name", F.when(F.col("name").endswith(".json"), changed).otherwise(F.col("text")).alias("text"))


def identity_text(spark, sf_dir):
    """The sentence on every identity of every source."""
    sp = F.explode(_get(F.parse_json(F.to_json("identity_consistency")), "speakers", "array<variant>")).alias("sp")
    return _jobs(spark, sf_dir).where("identity_consistency IS NOT NULL").select("source_id", sp).select("source_id", _get(F.col("sp"), "speaker", "int").alias("speaker"), _get(F.col("sp"), "display_name", "string").alias("display_name"), identity_sentence(F.col("sp")).alias("text"))


def speaker_rename(spark, sf_dir):
    """Names of speakers in segments, blocks and the list of speakers, after the speaker of each source's longest segment was renamed to
    its longest word."""
    segments, blocks = _named(spark, sf_dir)
    longest = F.col("end_ms") - F.col("start_ms")
    word = F.array_max(F.transform(F.split("text", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    renames = segments.groupBy("source_id").agg(F.max_by(F.struct("speaker", word.alias("word")), F.struct(longest, "place")).alias("x")).select("source_id", F.col("x.speaker").alias("old"), F.col("x.word").alias("new"))
    of = lambda kind, df, key: renamed(df.select("source_id", F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), "speaker"), renames)
    voices = segments.groupBy("source_id", "speaker").agg(F.min("place").alias("place"))
    return of("segment", segments, "place").unionByName(of("block", blocks, "block")).unionByName(of("speaker", voices, "place"))


_D = _Dialect(False)
_VALUES = ", ".join(f"('{k}', '{m}', '{a}', '{d}', {b})" for k, (m, a, d, b) in (*_PRESETS.items(), ("Personalizado", _OTHER)))
_JOBS_SQL = f"""{candidates.PASSES_SQL}, presets(k, model, asr, diar, beam) AS (VALUES {_VALUES}),
shown AS (SELECT source_id, raw_speaker, 'Persona ' || row_number() OVER (PARTITION BY source_id ORDER BY f) AS speaker FROM (SELECT source_id, raw_speaker, min(seg_id) AS f FROM segments GROUP BY ALL)),
snap AS ({validation.OWN['speaker_count_snapshot'][1]}),
idn AS (WITH {_D.summary().replace('turn_embeddings', 'sampled_turns')}, {_OVERALL} SELECT v.*, overall_confidence FROM verdict v JOIN overall USING (source_id)),
over_all AS (SELECT DISTINCT source_id AS o_id, overall_confidence FROM idn),
base AS (SELECT s.source_id, g.glossary, lower(regexp_extract(g.glossary, '^[A-Za-z]+')) AS word, coalesce(profile, 'Personalizado') AS gp, strftime(latest, '%Y-%m-%dT%H:%M:%S') AS created_at, audio_cs, model_load_cs, asr_cs, diarization_cs, export_cs, overhead_cs,
  coalesce(asr_cs + diarization_cs + export_cs + overhead_cs, 0) AS work FROM (SELECT DISTINCT source_id FROM segments) s JOIN (SELECT source_id, arg_min(text, seg_id) AS glossary FROM segments GROUP BY 1) g USING (source_id)
  LEFT JOIN prof ON prof.user_id = s.source_id LEFT JOIN job_metrics ON job_id = s.source_id LEFT JOIN (SELECT user_id, max(ts) AS latest FROM events GROUP BY 1) t ON t.user_id = s.source_id),
j AS (SELECT *, word || '.01' || CASE WHEN row_number() OVER (PARTITION BY word ORDER BY source_id) > 1 THEN ' (' || row_number() OVER (PARTITION BY word ORDER BY source_id) || ')' ELSE '' END AS stem FROM base JOIN presets ON k = gp)"""
_C = exports._CLEAN
_BLOCK_NAMED = f"named AS (SELECT b.*, x.speaker AS who FROM (WITH RECURSIVE {BLOCKS_CTE} SELECT * FROM blocks) b JOIN shown x ON x.source_id = b.source_id AND x.raw_speaker = b.speaker)"
_MD_HEAD = """'# Transcripción: ' || word || '.01.wav' || chr(10) || chr(10) || '- **Modelo:** ' || model || chr(10) || '- **Idioma:** ' || CASE WHEN gp = 'Preciso' THEN 'es' ELSE 'auto' END || chr(10) || '- **Duración:** ' || {a} || chr(10) || '- **Procesamiento:** ' || {p} || chr(10)
  || '- **Velocidad:** ' || printf('%.2f', CASE WHEN work > 0 THEN coalesce(audio_cs, 0) / work ELSE 0 END) || '× tiempo real' || chr(10) || chr(10) || '## Transcripción' || chr(10) || chr(10)""".format(a=exports._hm("coalesce(audio_cs * 10, 0)"), p=exports._hm("(work * 10)"))


def _texts_sql(who: str) -> str:
    return f"""tx AS (SELECT source_id, rtrim(string_agg('[' || {exports._hm('start_ms')} || '] ' || {who} || CASE WHEN review_required THEN ' [REVISAR]' ELSE '' END || chr(10) || text || chr(10), chr(10) ORDER BY block), chr(10)) || chr(10) AS text FROM named GROUP BY source_id),
mx AS (SELECT source_id, string_agg('### [' || {exports._hm('start_ms')} || '] · **' || {who} || '**' || CASE WHEN review_required THEN ' · ⚠ **REVISAR**' ELSE '' END || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY block) AS body FROM named GROUP BY source_id)"""


_S = "sg AS (SELECT s.*, x.speaker FROM segments s JOIN shown x USING (source_id, raw_speaker))"
_FIRST = "ren AS (SELECT source_id AS r_id, arg_min(speaker, seg_id) AS old, coalesce(nullif(upper(left(regexp_extract(arg_min(text, seg_id), '^[A-Za-z]+'), 1)) || lower(substr(regexp_extract(arg_min(text, seg_id), '^[A-Za-z]+'), 2)), ''), arg_min(speaker, seg_id)) AS fresh FROM sg GROUP BY 1)"
_SENTENCE = """confidence || ' · ' || turns || ' turno(s) · ' || printf('%.1f', total_ms / 1000.0::DOUBLE) || ' s · ' || embedded_turns || ' muestra(s) acústica(s)' || CASE least(embedded_turns, 3) WHEN 0 THEN ' · similitud no evaluable' WHEN 1 THEN ' · muestra única; similitud no evaluable'
  WHEN 2 THEN coalesce(' · similitud entre apariciones ' || printf('%.2f', round(pair, 6)), '') || coalesce(' · rival máx ' || printf('%.2f', round(rival, 6)), '') || CASE WHEN max_gap_ms > 0 THEN ' · separación máx ' || printf('%.1f', max_gap_ms / 1000.0::DOUBLE) || ' s' ELSE '' END
  ELSE coalesce(' · prototipo mediana ' || printf('%.2f', round(own_median, 6)), '') || coalesce(' · mínimo ' || printf('%.2f', round(own_min, 6)), '') || coalesce(' · rival máx ' || printf('%.2f', round(rival, 6)), '') END"""
_CLOCK = lambda c: exports._hm(f"coalesce({c} * 10, 0)")
_S2 = lambda c: f"printf('%.2f s', coalesce({c}, 0) / 100.0::DOUBLE)"
_ROWS = [
    ("'Archivo'", "word || '.01.wav'", ""), ("'Modelo'", "model", ""), ("'Idioma'", "CASE WHEN gp = 'Preciso' THEN 'es' ELSE 'auto' END", ""), ("'Perfil ASR'", "asr", ""), ("'Backend'", "'cpu / int8'", ""), ("'Batch'", "CASE WHEN gp = 'Rápido' THEN 'secuencial' ELSE '4' END", ""), ("'Beam'", "beam::VARCHAR", ""),
    ("'Hablantes'", "CASE WHEN audio_cs IS NULL THEN 'No' ELSE 'Auto · estimación acústica: ' || n_id || ' · con texto: ' || n_tx || ' · confianza no determinada' END", ""), ("'Perfil diarización'", "diar", ""), ("'Window shift'", "'—'", ""), ("'Hilos diarización'", "'—'", ""), ("'Pasadas Auto'", "CASE WHEN again THEN '2' ELSE '1' END", ""),
    ("'Selección Auto'", "coalesce(why, '—')", ""), ("'Duración'", _CLOCK("audio_cs"), ""), ("'Carga de modelo'", _CLOCK("model_load_cs"), ""), ("'Transcripción ASR'", _CLOCK("asr_cs"), ""), ("'Identificación hablantes'", _CLOCK("diarization_cs"), ""), ("'Exportación'", _CLOCK("export_cs"), ""), ("'Otros'", _CLOCK("overhead_cs"), ""),
    ("'Procesamiento'", _CLOCK("work"), ""), ("'Espera extremo a extremo'", _CLOCK("(work + model_load_cs)"), ""), ("'Velocidad'", "printf('%.2f× tiempo real', CASE WHEN work > 0 THEN coalesce(audio_cs, 0) / work ELSE 0 END)", ""),
    ("'Auto hablantes'", "'umbral elegido ' || CASE WHEN took THEN printf('%.2f', th) ELSE '0.74' END", "why IS NOT NULL"), ("'Motivo segunda pasada'", "reason", "reason IS NOT NULL"), ("'Alineación hablantes'", "'— · 0 segmento(s) divididos · 0 cambio(s) interno(s)'", ""), ("'Timestamps palabra internos'", "'No'", ""),
    ("'Worker diarización'", "'persistente · job — · motor inicializado'", ""), ("'Preparación modelos diar.'", "'0.00 s'", ""), ("'Inicialización motor diar.'", "'0.00 s'", ""), ("'Decodificación diar.'", "'0.00 s'", ""), ("'Proceso sherpa (wall)'", "'0.00 s'", ""), ("'Sherpa segmentación'", _S2("overhead_cs"), "gp = 'Preciso'"), ("'Sherpa embeddings'", _S2("export_cs"), "gp = 'Preciso'"),
    ("'Sherpa clustering'", "'0.00 s'", "gp = 'Preciso'"), ("'Sherpa total interno'", _S2("diarization_cs"), "gp = 'Preciso'"), ("'Timers internos sherpa'", "'no capturados por el backend/SO; se conserva medición wall'", "gp <> 'Preciso'"), ("'Control identidad V5.2'", "'Sí · control acústico conservador y selección identity-aware'", "o_id IS NOT NULL"), ("'Identidad total (wall)'", "'0.00 s'", "o_id IS NOT NULL"),
    ("'Embeddings identidad'", "'0 cálculo(s) · 0.00 s'", "o_id IS NOT NULL"), ("'Refinamiento identidad'", "'0 turno(s) reasignado(s) · 0 identidad(es) nueva(s)'", "o_id IS NOT NULL"), ("'Escaneo local'", "'0 turno(s) largo(s) · 0 cambio(s) aplicado(s)'", "o_id IS NOT NULL"), ("'Consistencia identidad'", "overall_confidence", "o_id IS NOT NULL"), None,
    ("'Rendimiento diarización'", "'Precisa prioriza resolución temporal y puede ser muy lenta en CPU; Equilibrada es el perfil recomendado.'", "gp = 'Preciso'"), ("'Clusters sherpa seleccionados'", "n_raw::VARCHAR", ""), ("'Clusters tras control identidad'", "n_id::VARCHAR", ""), ("'Hablantes con texto'", "n_tx::VARCHAR", ""),
    ("'Clusters acústicos sin texto'", "coalesce(nullif(replace(loose, ',', ', '), ''), '0')", ""), ("'Segunda pasada solicitada'", "CASE WHEN reason IS NOT NULL THEN 'Sí' ELSE 'No' END", ""), ("'Segunda pasada evitada'", "CASE WHEN settled THEN 'Sí' ELSE 'No' END", ""), ("'Segunda pasada omitida por presupuesto'", "CASE WHEN skipped THEN 'Sí' ELSE 'No' END", ""),
    ("'Presupuesto diarización Auto'", "printf('%.2f s', budget / 100.0::DOUBLE)", "budget IS NOT NULL"), ("'Precheck rendimiento Auto'", "'0.00 s · ' || n_a || '→' || l_n || ' · ' || CASE WHEN settled THEN 'aceptado' ELSE 'no concluyente' END", "frag"),
    ("'Selección Auto identity-aware'", "CASE WHEN wins THEN 'second' ELSE 'first' END || ' · score 1 ' || printf('%.2f', s_a) || ' · score 2 ' || printf('%.2f', s_b)", "again AND aware"), ("'Presupuesto de rendimiento'", "CASE WHEN work <= audio_cs THEN 'cumplido' ELSE 'sobre tiempo real' END || ' · proceso/audio ' || printf('%.2f×', work / audio_cs)", "audio_cs > 0"), ("'Modo global'", "gp", ""),
]
REPORT_ORACLE = f"""{_JOBS_SQL},
f AS (SELECT j.*, r.* EXCLUDE (source_id), o_id, overall_confidence, raw_acoustic_clusters AS n_raw, identity_clusters_after_refinement AS n_id, text_assigned_speakers AS n_tx, unassigned_raw_ids AS loose, CASE WHEN r.source_id IS NOT NULL THEN job.budget END AS budget
  FROM j LEFT JOIN r ON r.source_id = j.source_id LEFT JOIN over_all ON o_id = j.source_id LEFT JOIN snap ON snap.source_id = j.source_id LEFT JOIN job ON job.job_id = j.source_id),
e AS (SELECT source_id, unnest([{', '.join("{'p': " + str(k) + ", 'label': " + r[0] + ", 'value': " + r[1] + ", 'ok': " + (r[2] or 'true') + "}" for k, r in enumerate(_ROWS) if r)}]) AS x FROM f),
every AS (SELECT source_id, x.p AS p, -1 AS q, x.label AS label, x.value AS value FROM e WHERE x.ok
  UNION ALL SELECT i.source_id, {_ROWS.index(None)}, i.speaker, CASE WHEN h.speaker IS NOT NULL THEN 'Identidad ' || h.speaker WHEN list_contains(string_split(loose, ','), i.speaker::VARCHAR) THEN 'Cluster acústico raw ' || i.speaker || ' (sin texto)' ELSE 'Cluster acústico raw ' || i.speaker END, {_SENTENCE}
  FROM idn i JOIN f USING (source_id) LEFT JOIN shown h ON h.source_id = i.source_id AND h.raw_speaker = i.speaker)
SELECT source_id, (row_number() OVER (PARTITION BY source_id ORDER BY p, q) - 1)::INTEGER AS place, label, value FROM every"""

OWN = {
    "json_document": (json_document, f"""{_JOBS_SQL}, {_BLOCK_NAMED}, {_S},
texts_ AS (SELECT source_id, string_agg({_C}, ' ' ORDER BY seg_id) AS text, count(*) AS n_segments FROM segments GROUP BY source_id),
blocks_ AS (SELECT source_id, count(*) AS n_blocks, count(*) FILTER (review_required) AS flagged_blocks FROM named GROUP BY source_id),
voices_ AS (SELECT source_id, string_agg(speaker || '=' || n, ',' ORDER BY f) AS speakers FROM (SELECT source_id, speaker, count(*) AS n, min(seg_id) AS f FROM sg GROUP BY ALL) GROUP BY source_id)
SELECT stem || '.json' AS name, 'ok' AS status, 8 AS schema_version, word || '.01.wav' AS source, CASE WHEN gp = 'Preciso' THEN 'es' ELSE 'auto' END AS language, created_at, asr AS profile, len(list_filter(list_transform(regexp_split_to_array(glossary, '[,;\\n]+'), lambda x: trim(x)), lambda x: x <> ''))::BIGINT AS n_hotwords, texts_.text, n_segments, n_blocks, flagged_blocks, false AS edited, speakers,
  beam AS beam_size, gp <> 'Rápido' AS batched, diar AS diarization_profile, round(work / 100.0::DOUBLE, 6) AS processing_seconds, round((work + coalesce(model_load_cs, 0)) / 100.0::DOUBLE, 6) AS end_to_end_seconds, round(CASE WHEN work > 0 THEN coalesce(audio_cs, 0)::DOUBLE / work END, 6) AS speed_x, audio_cs IS NOT NULL AS enabled, raw_acoustic_clusters AS detected_speakers, why AS selection_reason,
  CASE WHEN r.source_id IS NULL THEN 0 WHEN again THEN 2 ELSE 1 END::BIGINT AS n_candidates, text_assigned_speakers, overall_confidence, coalesce(skipped, false) AS retry_skipped_budget, CASE WHEN audio_cs > 0 THEN 'processing_seconds <= audio_seconds' ELSE 'unknown' END AS target, CASE WHEN audio_cs > 0 THEN work <= audio_cs END AS within_realtime,
  CASE WHEN audio_cs > 0 THEN round(greatest(0, work - audio_cs) / 100.0::DOUBLE, 6) END AS seconds_over_realtime, gp AS global_profile
FROM j JOIN texts_ USING (source_id) JOIN blocks_ USING (source_id) JOIN voices_ USING (source_id) LEFT JOIN snap USING (source_id) LEFT JOIN r ON r.source_id = j.source_id LEFT JOIN over_all ON o_id = j.source_id"""),
    "export_files": (export_files, f"""{_JOBS_SQL}, {_BLOCK_NAMED}, {_S}, {_texts_sql('who')},
st AS (SELECT source_id, string_agg((seg_id + 1) || chr(10) || {exports._stamp('start_ms', ',')} || ' --> ' || {exports._stamp('end_ms', ',')} || chr(10) || speaker || ': ' || {_C} || chr(10), chr(10) ORDER BY seg_id) AS srt, 'WEBVTT' || chr(10) || chr(10) || string_agg({exports._stamp('start_ms', '.')} || ' --> ' || {exports._stamp('end_ms', '.')} || chr(10) || speaker || ': ' || {_C} || chr(10), chr(10) ORDER BY seg_id) AS vtt FROM sg GROUP BY source_id)
SELECT stem || '.txt' AS name, text FROM j JOIN tx USING (source_id) UNION ALL SELECT stem || '.md', rtrim({_MD_HEAD} || body, chr(10)) || chr(10) FROM j JOIN mx USING (source_id) UNION ALL SELECT stem || '.srt', srt FROM j JOIN st USING (source_id) UNION ALL SELECT stem || '.vtt', vtt FROM j JOIN st USING (source_id)"""),
    "revision_export": (revision_export, f"""{_JOBS_SQL}, {_BLOCK_NAMED}, {_S}, {_FIRST}, {_texts_sql("(SELECT CASE WHEN who = old THEN fresh ELSE who END FROM ren WHERE r_id = source_id)")},
names_ AS (SELECT source_id, string_agg(DISTINCT CASE WHEN speaker = old THEN fresh ELSE speaker END, ',' ORDER BY CASE WHEN speaker = old THEN fresh ELSE speaker END) AS names FROM sg JOIN ren ON r_id = source_id GROUP BY source_id),
u_ AS (SELECT *, word || '.01_revision_20240102_030405' || CASE WHEN row_number() OVER (PARTITION BY word ORDER BY source_id) > 1 THEN ' (' || row_number() OVER (PARTITION BY word ORDER BY source_id) || ')' ELSE '' END AS s2 FROM j)
SELECT s2 || '.txt' AS name, text FROM u_ JOIN tx USING (source_id) UNION ALL SELECT s2 || '.md', rtrim({_MD_HEAD} || body, chr(10)) || chr(10) FROM u_ JOIN mx USING (source_id) UNION ALL SELECT s2 || '.json', '2|true|' || names || '|' || names || '|' || names || '|-' FROM u_ JOIN names_ USING (source_id)"""),
    "speaker_rename": (speaker_rename, f"""WITH shown AS (SELECT source_id, raw_speaker, 'Persona ' || row_number() OVER (PARTITION BY source_id ORDER BY f) AS speaker FROM (SELECT source_id, raw_speaker, min(seg_id) AS f FROM segments GROUP BY ALL)),
{_BLOCK_NAMED}, {_S}, far AS (SELECT source_id AS r_id, speaker AS old, list_sort(list_transform(string_split(text, ' '), lambda w: (length(w), w)), 'DESC')[1] AS best FROM sg QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY end_ms - start_ms DESC, seg_id DESC) = 1),
e AS (SELECT source_id, 'segment' AS kind, seg_id AS id, speaker FROM sg UNION ALL SELECT source_id, 'block', block, who FROM named UNION ALL SELECT source_id, 'speaker', min(seg_id), speaker FROM sg GROUP BY source_id, speaker)
SELECT source_id, kind, id, CASE WHEN speaker = old THEN best[2] ELSE speaker END AS speaker FROM e JOIN far ON r_id = source_id"""),
    "report_rows": (lambda spark, sf_dir: report(_jobs(spark, sf_dir)), REPORT_ORACLE),
    "identity_text": (identity_text, f"{_JOBS_SQL} SELECT i.source_id, i.speaker, h.speaker AS display_name, {_SENTENCE} AS text FROM idn i JOIN j USING (source_id) LEFT JOIN shown h ON h.source_id = i.source_id AND h.raw_speaker = i.speaker"),
}
