"""Presets, performance, outcomes and checks of files: rules as Column functions, and queries that reach each of their branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.scalars import EXTENSIONS, clean_text, has_media_extension, inside
from turnwise.operators.candidates import profiles
from turnwise.operators.documents import _get, closed
from turnwise.sources import views

#: The presets (model, transcription profile, speakers on, their mode, speaker profile) and the older ones of three.
PRESETS = {"Rápido": ("small", "Rapido", True, "Auto", "Rápida"), "Equilibrado": ("small", "Equilibrado", True, "Auto", "Equilibrada"), "Preciso": ("medium", "Preciso", True, "Auto", "Equilibrada")}
OLD_PRESETS = {"Rápido": ("small", "Rapido", "Rápida"), "Equilibrado": ("small", "Equilibrado", "Equilibrada"), "Preciso": ("medium", "Preciso", "Precisa")}
DEFAULT, OTHER = "Equilibrado", "Personalizado"


def preset(name: Column) -> Column:
    """The preset of a name as a struct (name, model, asr_profile, diarize, speaker_mode, diar_profile); unknown and null names are the
    default's, and the own one of the user has no values."""
    row = lambda n, v: F.struct(F.lit(n).alias("name"), *(F.lit(x).cast(t).alias(k) for k, x, t in zip(("model", "asr_profile", "diarize", "speaker_mode", "diar_profile"), v, ("string", "string", "boolean", "string", "string"), strict=True)))
    out = F.when(name == OTHER, row(OTHER, (None,) * 5))
    for n, v in PRESETS.items():
        out = out.when(name == n, row(n, v))
    return out.otherwise(row(DEFAULT, PRESETS[DEFAULT]))


def inferred(model: Column, asr: Column, diar: Column, diarize: Column, mode: Column) -> Column:
    """The preset that five settings make up. Without both of the last two the settings are old ones and only three count; one of
    them that is null isn't compared."""
    old = F.lit(None).cast("string")
    new = F.lit(None).cast("string")
    for n in reversed(PRESETS):
        m, a, d = OLD_PRESETS[n]
        old = F.when((model == m) & (asr == a) & (diar == d), n).otherwise(old)
        m, a, on, kind, d = PRESETS[n]
        new = F.when((model == m) & (asr == a) & (diar == d) & F.coalesce(diarize == on, F.lit(True)) & F.coalesce(mode == kind, F.lit(True)), n).otherwise(new)
    return F.coalesce(F.when(diarize.isNull() & mode.isNull(), old).otherwise(new), F.lit(OTHER))


def outcome(good: Column, bad: Column) -> Column:
    return F.when((good == 0) & (bad > 0), "total_fail").when(bad > 0, "partial").otherwise("complete")


def checked(files: DataFrame) -> DataFrame:
    """files (text, size, digest, pinned) with status: missing (null text), size (another number of bytes than told), hash (another
    SHA-256 than expected or, where none is expected, than pinned beside the file), else ok. Null expectations aren't compared; hashes are compared without regard to case."""
    own = F.sha2(F.col("text").cast("binary"), 256)
    told = F.lower(F.coalesce("digest", "pinned"))
    status = F.when(F.col("text").isNull(), "missing").when(F.col("size") != F.octet_length("text"), "size").when(told != own, "hash").otherwise("ok")
    return files.withColumn("status", status)


def glossary_list(text: Column) -> Column:
    """The entries of a glossary, each once and in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[,;\n]+"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""))


def ext_filter(spark, sf_dir):
    """Files named after documents: every known extension in either case, others, and none."""
    kinds = [*EXTENSIONS, ".txt", ".mp3.part", "", ".MP3", ".Flac", ".mp"]
    docs = views.read(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("."), F.col("lang"), F.element_at(F.array(*map(F.lit, kinds)), (F.length("text") % len(kinds) + 1).cast("int"))).alias("path"))
    return docs.select("doc_id", "path", has_media_extension(F.col("path")).alias("known"))


def path_containment(spark, sf_dir):
    """Pages that lie in a folder, or are one, of those that some page's address names up to its last slash but one letter."""
    pages = views.read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    folders = pages.where(F.pmod(F.length("path"), F.lit(4)) == 0).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"))
    near = pages.where(F.pmod(F.length("path"), F.lit(4)) == 1).select(F.regexp_extract("path", "^(.*).$", 1).alias("folder"))
    hits = inside(pages, folders.unionByName(near)).select("page_id", F.lit(True).alias("_in"))
    return pages.join(hits, "page_id", "left").select("page_id", F.coalesce("_in", F.lit(False)).alias("inside"))


def profile_lookup(spark, sf_dir):
    p = preset(F.col("event_type"))
    name = F.when(F.col("event_type") == "click", "Rápido").when(F.col("event_type") == "purchase", "Preciso").when(F.col("event_type") == "error", OTHER).when(F.col("event_type") == "view", "sin nombre")
    events = views.read(spark, sf_dir, "events").withColumn("event_type", name)
    return events.select("event_id", *(p[k].alias(k) for k in ("name", "model", "asr_profile", "diarize", "speaker_mode", "diar_profile")))


def preset_inference(spark, sf_dir):
    """The settings of a job are those that its last events of four kinds chose, and older settings where it has none of a kind."""
    e = views.read(spark, sf_dir, "events")
    last = lambda kind: F.max_by(F.when(F.col("event_type") == kind, F.floor(F.col("value"))), F.when(F.col("event_type") == kind, F.struct("ts", "event_id")))
    j = e.groupBy(F.col("user_id").alias("job_id"), F.to_date("ts").cast("string").alias("day")).agg(*(last(k).alias(k) for k in ("click", "view", "purchase", "signup", "error")))
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (F.pmod(F.coalesce(F.col(c), F.lit(0)), F.lit(len(v))) + 1).cast("int"))
    settings = j.select("job_id", "day", pick("click", "small", "medium").alias("model"), pick("view", "Rapido", "Equilibrado", "Preciso").alias("asr"), pick("purchase", "Rápida", "Equilibrada", "Precisa").alias("diar"), (F.col("signup") < 80).alias("diarize"), F.when(F.col("error") >= 15, "Auto").when(F.col("error").isNotNull(), "2").alias("mode"))
    return settings.withColumn("preset", inferred(*(F.col(c) for c in ("model", "asr", "diar", "diarize", "mode"))))


def _job_metrics(spark, sf_dir) -> DataFrame:
    m = views.job_metrics(spark, sf_dir)
    return m.select(F.col("job_id").alias("source_id"), *((F.col(f"{c}_cs") / 100.0).alias(f"{c}_seconds") for c in ("audio", "model_load", "asr", "diarization", "export", "overhead")), (F.greatest(F.col("overhead_cs") - F.col("export_cs"), F.lit(0)) / 100.0).alias("report_generation_seconds"))


def stage_metrics(spark, sf_dir):
    six = lambda c: F.round(c, 10).alias(c)
    return closed(_job_metrics(spark, sf_dir)).select(F.col("source_id").alias("job_id"), *map(six, ("processing_seconds", "end_to_end_seconds", "report_generation_seconds", "rtf", "speed_x")))


def performance_status(spark, sf_dir):
    p = F.col("performance")
    number = lambda c: F.round(_get(p, c, "double"), 10).alias(c)
    flag = lambda c: _get(p, c, "boolean").alias(c)
    jobs = _job_metrics(spark, sf_dir)
    silent = jobs.withColumns({"source_id": -F.col("source_id") - 1, "audio_seconds": F.lit(0.0)})
    idle = jobs.select((F.col("source_id") + 1_000_000).alias("source_id"), "audio_seconds")
    return closed(jobs.unionByName(silent).unionByName(idle, allowMissingColumns=True)).select(F.col("source_id").alias("job_id"), _get(p, "target", "string").alias("target"), flag("within_realtime"), number("processing_to_audio"), number("asr_share"), number("diarization_share"), number("seconds_over_realtime"), number("end_to_end_to_audio"), flag("end_to_end_within_realtime"), number("end_to_end_seconds_over_realtime"))


def batch_outcome(spark, sf_dir):
    """A batch is a user's day: purchases went well, errors failed."""
    n = lambda kind: F.sum(F.when(F.col("event_type") == kind, 1).otherwise(0)).cast("long")
    days = views.read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(n("purchase").alias("ok"), n("error").alias("failed"))
    return days.select("*", outcome(F.col("ok"), F.col("failed")).alias("outcome"))


def integrity_check(spark, sf_dir):
    """Documents as files: what is expected of each is what another copy of the table says of the document before it in its language
    and source, where that has the same length, and what labels say of its quality leaves some without a file or expectations."""
    docs = views.read(spark, sf_dir, "documents").join(views.read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    order = Window.partitionBy("source").orderBy("doc_id")
    same = F.lag("text").over(order) == F.col("text")
    files = docs.select(
        "doc_id", F.when((F.col("quality") == 0) & (F.col("toxic") == 0), F.lit(None)).otherwise(F.col("text")).alias("text"), F.when(F.col("lang") != "en", F.col("n_chars")).alias("size"),
        F.when(F.col("lang") == "en", F.upper(F.sha2(F.when(F.col("toxic") == 1, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256))).alias("digest"), F.when(same | (F.col("quality") == 1), F.sha2(F.regexp_replace("text", "ß", "ss"), 256)).alias("pinned"),
    )
    return checked(files).select("doc_id", "status")


def glossary_hotwords(spark, sf_dir):
    words = glossary_list(F.col("text"))
    return views.texts(spark, sf_dir).select("kind", "id", F.nullif(F.array_join(words, ", "), F.lit("")).alias("hotwords"), F.size(words).alias("n_hotwords"))


def clean_text_query(spark, sf_dir):
    """Texts whose commas have become blanks of other kinds."""
    return views.texts(spark, sf_dir).select("kind", "id", clean_text(F.translate("text", ",;", "　 ")).alias("text"))


_DIR = "regexp_extract(url, '^(.*)/[^/]*$', 1)"
_KINDS = ", ".join(f"'{k}'" for k in [*EXTENSIONS, ".txt", ".mp3.part", "", ".MP3", ".Flac", ".mp"])
_KNOWN = ", ".join(f"'{k}'" for k in EXTENSIONS)
_JOBS = "m AS (SELECT *, greatest(overhead_cs - export_cs, 0) AS rep, asr_cs + diarization_cs + export_cs + overhead_cs AS work FROM job_metrics), c AS (SELECT *, work + model_load_cs + rep AS whole FROM m)"
_SIX = lambda x, name: f"round({x}, 10) AS {name}"
OWN = {
    "ext_filter": (ext_filter, f"""WITH f AS (SELECT doc_id, source || '.' || lang || [{_KINDS}][length(text) % {len(EXTENSIONS) + 6} + 1] AS path FROM documents)
SELECT doc_id, path, CASE WHEN contains(path, '.') THEN lower('.' || split_part(path, '.', -1)) IN ({_KNOWN}) ELSE false END AS known FROM f"""),
    "path_containment": (path_containment, f"""WITH f AS (SELECT DISTINCT rtrim({_DIR}, '/') AS folder FROM pages WHERE length(url) % 4 = 0 UNION SELECT rtrim(left(url, length(url) - 1), '/') FROM pages WHERE length(url) % 4 = 1)
SELECT page_id, EXISTS (SELECT 1 FROM f WHERE folder <> '' AND (url = folder OR starts_with(url, folder || '/'))) AS inside FROM pages"""),
    "profile_lookup": (profile_lookup, """WITH p(name, model, asr_profile, diarize, speaker_mode, diar_profile) AS (VALUES ('Rápido', 'small', 'Rapido', true, 'Auto', 'Rápida'), ('Equilibrado', 'small', 'Equilibrado', true, 'Auto', 'Equilibrada'), ('Preciso', 'medium', 'Preciso', true, 'Auto', 'Equilibrada'), ('Personalizado', NULL, NULL, NULL, NULL, NULL))
SELECT event_id, p.* FROM events JOIN p ON p.name = coalesce(MAP {'click': 'Rápido', 'purchase': 'Preciso', 'error': 'Personalizado'}[event_type], 'Equilibrado')"""),
    "preset_inference": (preset_inference, """WITH p(preset, model, asr, diar, old) AS (VALUES ('Rápido', 'small', 'Rapido', 'Rápida', 'Rápida'), ('Equilibrado', 'small', 'Equilibrado', 'Equilibrada', 'Equilibrada'), ('Preciso', 'medium', 'Preciso', 'Equilibrada', 'Precisa')),
v AS (SELECT user_id AS job_id, strftime(ts, '%Y-%m-%d') AS day, event_type, arg_max(floor(value), (ts, event_id))::BIGINT AS v FROM events GROUP BY ALL), d AS (SELECT DISTINCT job_id, day FROM v),
k AS (SELECT d.*, a.v AS a, b.v AS b, c.v AS c, s.v AS s, e.v AS e FROM d LEFT JOIN v a ON a.job_id = d.job_id AND a.day = d.day AND a.event_type = 'click' LEFT JOIN v b ON b.job_id = d.job_id AND b.day = d.day AND b.event_type = 'view' LEFT JOIN v c ON c.job_id = d.job_id AND c.day = d.day AND c.event_type = 'purchase'
  LEFT JOIN v s ON s.job_id = d.job_id AND s.day = d.day AND s.event_type = 'signup' LEFT JOIN v e ON e.job_id = d.job_id AND e.day = d.day AND e.event_type = 'error'),
j AS (SELECT job_id, day, ['small', 'medium'][coalesce(a, 0) % 2 + 1] AS model, ['Rapido', 'Equilibrado', 'Preciso'][coalesce(b, 0) % 3 + 1] AS asr, ['Rápida', 'Equilibrada', 'Precisa'][coalesce(c, 0) % 3 + 1] AS diar, s < 80 AS diarize, CASE WHEN e IS NOT NULL THEN CASE WHEN e >= 15 THEN 'Auto' ELSE '2' END END AS mode FROM k)
SELECT j.*, coalesce(preset, 'Personalizado') AS preset FROM j LEFT JOIN p ON p.model = j.model AND p.asr = j.asr AND CASE WHEN diarize IS NULL AND mode IS NULL THEN j.diar = p.old ELSE j.diar = p.diar AND coalesce(diarize, true) AND coalesce(mode, 'Auto') = 'Auto' END"""),
    "stage_metrics": (stage_metrics, f"WITH {_JOBS} SELECT job_id, {_SIX('work / 100.0::DOUBLE', 'processing_seconds')}, {_SIX('whole / 100.0::DOUBLE', 'end_to_end_seconds')}, {_SIX('rep / 100.0::DOUBLE', 'report_generation_seconds')}, {_SIX('work::DOUBLE / nullif(audio_cs, 0)', 'rtf')}, {_SIX('audio_cs::DOUBLE / nullif(work, 0)', 'speed_x')} FROM c"),
    "performance_status": (performance_status, f"""WITH {_JOBS}, w AS (SELECT job_id, audio_cs, work, whole, asr_cs, diarization_cs FROM c UNION ALL SELECT -job_id - 1, 0, work, whole, asr_cs, diarization_cs FROM c UNION ALL SELECT job_id + 1000000, audio_cs, 0, 0, 0, 0 FROM c)
SELECT job_id, CASE WHEN audio_cs > 0 THEN 'processing_seconds <= audio_seconds' ELSE 'unknown' END AS target, CASE WHEN audio_cs > 0 THEN work <= audio_cs END AS within_realtime, {_SIX('work::DOUBLE / nullif(audio_cs, 0)', 'processing_to_audio')}, CASE WHEN audio_cs > 0 THEN round(coalesce(asr_cs::DOUBLE / nullif(work, 0), 0), 10) END AS asr_share,
  CASE WHEN audio_cs > 0 THEN round(coalesce(diarization_cs::DOUBLE / nullif(work, 0), 0), 10) END AS diarization_share, CASE WHEN audio_cs > 0 THEN round(greatest(work - audio_cs, 0) / 100.0::DOUBLE, 10) END AS seconds_over_realtime, CASE WHEN audio_cs > 0 AND whole > 0 THEN round(whole::DOUBLE / audio_cs, 10) END AS end_to_end_to_audio,
  CASE WHEN audio_cs > 0 AND whole > 0 THEN whole <= audio_cs END AS end_to_end_within_realtime, CASE WHEN audio_cs > 0 AND whole > 0 THEN round(greatest(whole - audio_cs, 0) / 100.0::DOUBLE, 10) END AS end_to_end_seconds_over_realtime FROM w"""),
    "batch_outcome": (batch_outcome, "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type = 'error') AS failed, CASE WHEN bool_or(event_type = 'error') THEN CASE WHEN bool_or(event_type = 'purchase') THEN 'partial' ELSE 'total_fail' END ELSE 'complete' END AS outcome FROM events GROUP BY ALL"),
    "integrity_check": (integrity_check, """WITH d AS (SELECT d.*, quality, toxic, lag(text) OVER (PARTITION BY source ORDER BY d.doc_id) AS before FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, CASE WHEN quality = 0 AND toxic = 0 THEN 'missing' WHEN lang <> 'en' AND n_chars <> octet_length(encode(text)) THEN 'size' WHEN lang = 'en' AND toxic = 1 THEN 'hash' WHEN lang = 'en' THEN 'ok' WHEN coalesce(before = text, false) OR coalesce(quality = 1, false) THEN CASE WHEN contains(text, 'ß') THEN 'hash' ELSE 'ok' END ELSE 'ok' END AS status FROM d"""),
    "glossary_hotwords": (glossary_hotwords, r"""WITH w AS (SELECT kind, id, p, trim(part) AS word FROM (SELECT kind, id, unnest(regexp_split_to_array(text, '[,;\n]+')) AS part, generate_subscripts(regexp_split_to_array(text, '[,;\n]+'), 1) AS p FROM texts)),
f AS (SELECT kind, id, word, min(p) AS p FROM w WHERE word <> '' GROUP BY ALL), g AS (SELECT kind, id, string_agg(word, ', ' ORDER BY p) AS hotwords, count(*)::INTEGER AS n FROM f GROUP BY ALL) SELECT t.kind, t.id, hotwords, coalesce(n, 0) AS n_hotwords FROM texts t LEFT JOIN g ON g.kind = t.kind AND g.id = t.id"""),
    "clean_text": (clean_text_query, r"SELECT kind, id, array_to_string(list_filter(regexp_split_to_array(text, '[ \n\t\r,;]'), lambda x: x <> ''), ' ') AS text FROM texts"),
}
