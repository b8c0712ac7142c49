"""Intervals of transcripts and turns: overlap and nearest joins, merging, remapping, layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.plans.query import Query


def bucketed_overlap(left: DataFrame, right: DataFrame, key: str, width_ms: int, slack_ms: int = 0) -> DataFrame:
    """Pairs of rows of one key whose [start_ms, end_ms) overlap, or lie within slack_ms: columns of right get the prefix r_.

    Intervals are replicated into time buckets of width_ms, so that a long source is many join keys rather than one; each
    pair is kept in the bucket where its later start lies."""
    def cut(df, a, b, pad):
        first, last = F.floor((F.col(a) - pad) / width_ms), F.floor((F.greatest(F.col(b), F.col(a)) + pad) / width_ms)
        return df.withColumn("_b", F.explode(F.sequence(first.cast("long"), last.cast("long"))))

    other = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    pairs = cut(left, "start_ms", "end_ms", slack_ms).join(
        cut(other, "r_start_ms", "r_end_ms", 0).withColumnRenamed("_b", "_rb"), (F.col(key) == F.col(f"r_{key}")) & (F.col("_b") == F.col("_rb"))
    )
    close = (F.col("r_start_ms") - slack_ms <= F.col("end_ms")) & (F.col("r_end_ms") + slack_ms >= F.col("start_ms"))
    here = F.col("_b") == F.greatest(F.floor((F.col("start_ms") - slack_ms) / width_ms), F.floor(F.col("r_start_ms") / width_ms))
    return pairs.where(close & here).drop("_b", "_rb")


def assign_speakers(items: DataFrame, turns: DataFrame, ids: list[str], nearest_ms: int | None = None, width_ms: int = 60_000) -> DataFrame:
    """items with speaker: that of most overlap, of equals the one whose overlapping turn comes first; without overlap the turn
    that holds the midpoint, and with nearest_ms the turn whose bound is nearest to it, no farther than that."""
    valid = turns.where("end_ms > start_ms")
    near = bucketed_overlap(items, valid, "source_id", width_ms, nearest_ms or 0)
    overlap = F.greatest(F.lit(0), F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms"))
    twice = F.col("start_ms") + F.col("end_ms")
    away = F.when((F.col("r_start_ms") * 2 <= twice) & (twice <= F.col("r_end_ms") * 2), F.lit(-1)).otherwise(F.least(F.abs(twice - F.col("r_start_ms") * 2), F.abs(twice - F.col("r_end_ms") * 2)))
    most = -1 if nearest_ms is None else 2 * nearest_ms
    scored = near.select(*ids, F.col("r_raw_speaker").alias("s"), overlap.alias("o"), away.alias("away"), F.struct("r_start_ms", "r_end_ms").alias("at"))
    sums = scored.groupBy(*ids, "s").agg(
        F.sum("o").alias("o"), F.min(F.when(F.col("o") > 0, F.col("at"))).alias("first"), F.min(F.when(F.col("away") <= most, F.struct("away", "at"))).alias("near")
    )
    # Overlap first; midpoints inside a turn tie and go to the earliest turn; then the least distance.
    best = sums.groupBy(*ids).agg(
        F.min(F.when(F.col("o") > 0, F.struct((-F.col("o")).alias("k"), F.col("first"), F.col("s")))).alias("a"), F.min(F.when(F.col("near").isNotNull(), F.struct("near", "s"))).alias("b")
    )
    return items.join(best.select(*ids, F.coalesce(F.col("a.s"), F.col("b.s")).alias("speaker")), ids, "left")


def speaker_assign_overlap(spark, sf_dir):
    from turnwise.sources import views

    segments, turns = views.segments(spark, sf_dir), views.turns(spark, sf_dir)
    found = assign_speakers(segments.select("source_id", "seg_id", "start_ms", "end_ms"), turns, ["source_id", "seg_id"])
    names = turns.where("end_ms > start_ms").select("source_id", F.col("raw_speaker").alias("speaker")).distinct()
    from pyspark.sql import Window

    names = names.withColumn("name", F.concat(F.lit("Persona "), F.row_number().over(Window.partitionBy("source_id").orderBy("speaker"))))
    return found.join(names, ["source_id", "speaker"], "left").select("source_id", "seg_id", F.col("speaker").alias("speaker_id"), F.col("name").alias("speaker"))


_VALID = "(SELECT * FROM turns WHERE end_ms > start_ms)"
_SPEAKER_DUCK = """
{item} AS (SELECT * FROM {table}),
pair AS (SELECT {ids}, t.raw_speaker AS s, greatest(0, least(i.end_ms, t.end_ms) - greatest(i.start_ms, t.start_ms)) AS o, t.start_ms AS ts, t.end_ms AS te,
  CASE WHEN 2 * t.start_ms <= i.start_ms + i.end_ms AND i.start_ms + i.end_ms <= 2 * t.end_ms THEN -1 ELSE least(abs(i.start_ms + i.end_ms - 2 * t.start_ms), abs(i.start_ms + i.end_ms - 2 * t.end_ms)) END AS away
  FROM {item} i JOIN turns t ON t.source_id = i.source_id AND t.end_ms > t.start_ms),
ranked AS (SELECT {plain}, s, sum(o) AS o, min(CASE WHEN o > 0 THEN (ts, te) END) AS first FROM pair GROUP BY {plain}, s),
overlap AS (SELECT {plain}, s FROM (SELECT *, row_number() OVER (PARTITION BY {plain} ORDER BY o DESC, first) AS r FROM ranked WHERE o > 0) WHERE r = 1),
near AS (SELECT {plain}, s FROM (SELECT *, row_number() OVER (PARTITION BY {plain} ORDER BY away, ts, te) AS r FROM pair WHERE away <= {most}) WHERE r = 1)"""


def _duck_speakers(table: str, ids: str, most: int) -> str:
    return _SPEAKER_DUCK.format(item="item", table=table, ids=", ".join("i." + c for c in ids.split(", ")), plain=ids, most=most)


SPEAKER_ASSIGN_ORACLE = f"""WITH {_duck_speakers('segments', 'source_id, seg_id', -1)},
names AS (SELECT source_id, raw_speaker AS s, 'Persona ' || row_number() OVER (PARTITION BY source_id ORDER BY raw_speaker) AS name FROM (SELECT DISTINCT source_id, raw_speaker FROM turns WHERE end_ms > start_ms))
SELECT g.source_id, g.seg_id, coalesce(o.s, n.s) AS speaker_id, p.name AS speaker FROM segments g LEFT JOIN overlap o USING (source_id, seg_id) LEFT JOIN near n USING (source_id, seg_id)
LEFT JOIN names p ON p.source_id = g.source_id AND p.s = coalesce(o.s, n.s)"""


def word_speaker_align(spark, sf_dir):
    """Words, each with a speaker by overlap, midpoint or a turn bound within 0.65 s."""
    from turnwise.sources import views

    words = views.words(spark, sf_dir)
    return assign_speakers(words, views.turns(spark, sf_dir), ["source_id", "seg_id", "word_idx"], nearest_ms=650).select("source_id", "seg_id", "word_idx", "word", "speaker")


WORD_ALIGN_ORACLE = f"""WITH {_duck_speakers('words', 'source_id, seg_id, word_idx', 1300)}
SELECT w.source_id, w.seg_id, w.word_idx, w.word, coalesce(o.s, n.s) AS speaker FROM words w LEFT JOIN overlap o USING (source_id, seg_id, word_idx) LEFT JOIN near n USING (source_id, seg_id, word_idx)"""


def by_words_or_bounds(segments: DataFrame, words: DataFrame, turns: DataFrame, nearest_ms: int = 650) -> DataFrame:
    """source_id, seg_id, branch, timed_words, speaker of every segment: where it has words with both bounds, the speaker that most of
    them are given (of equals the least; null if none is), else that of its own bounds."""
    timed = words.where("start_ms IS NOT NULL AND end_ms IS NOT NULL")
    given = assign_speakers(timed.select("source_id", "seg_id", "word_idx", "start_ms", "end_ms"), turns, ["source_id", "seg_id", "word_idx"], nearest_ms=nearest_ms)
    votes = given.groupBy("source_id", "seg_id", "speaker").agg(F.count("*").alias("n")).groupBy("source_id", "seg_id")
    heard = votes.agg(F.sum("n").alias("timed_words"), F.max_by("speaker", F.when(F.col("speaker").isNotNull(), F.struct("n", -F.col("speaker")))).alias("speaker"))
    every = segments.select("source_id", "seg_id", "start_ms", "end_ms")
    bare = assign_speakers(every.join(heard, ["source_id", "seg_id"], "left_anti"), turns, ["source_id", "seg_id"], nearest_ms=nearest_ms)
    own = every.select("source_id", "seg_id").join(heard, ["source_id", "seg_id"]).select("source_id", "seg_id", F.lit("words").alias("branch"), "timed_words", "speaker")
    return own.unionByName(bare.select("source_id", "seg_id", F.lit("segment").alias("branch"), F.lit(0).cast("long").alias("timed_words"), "speaker"))


def segment_fallback_align(spark, sf_dir):
    """Every segment, by its words or by its own bounds. Words of up to four letters have no end here."""
    from turnwise.sources import views

    words = views.words(spark, sf_dir).withColumn("end_ms", F.when(F.length("word") > 4, F.col("end_ms")))
    return by_words_or_bounds(views.segments(spark, sf_dir), words, views.turns(spark, sf_dir))


FALLBACK_ORACLE = f"""WITH timed AS (SELECT * FROM words WHERE length(word) > 4),
w AS (WITH {_duck_speakers('timed', 'source_id, seg_id, word_idx', 1300)} SELECT t.source_id, t.seg_id, t.word_idx, coalesce(o.s, n.s) AS s FROM timed t LEFT JOIN overlap o USING (source_id, seg_id, word_idx) LEFT JOIN near n USING (source_id, seg_id, word_idx)),
v AS (SELECT source_id, seg_id, s, count(*) AS n FROM w GROUP BY ALL), m AS (SELECT source_id, seg_id, sum(n)::BIGINT AS timed_words FROM v GROUP BY ALL),
best AS (SELECT source_id, seg_id, s FROM v WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id, seg_id ORDER BY n DESC, s) = 1),
b AS (WITH {_duck_speakers('(SELECT * FROM segments ANTI JOIN timed USING (source_id, seg_id))', 'source_id, seg_id', 1300)} SELECT g.source_id, g.seg_id, coalesce(o.s, n.s) AS s FROM item g LEFT JOIN overlap o USING (source_id, seg_id) LEFT JOIN near n USING (source_id, seg_id))
SELECT source_id, seg_id, 'words' AS branch, timed_words, s AS speaker FROM m LEFT JOIN best USING (source_id, seg_id) UNION ALL SELECT source_id, seg_id, 'segment', 0, s FROM b"""

#: Runs of one speaker, cut again where a pause is longer than the gap: a table of merged turns.
MERGE = """run AS (SELECT *, sum(CASE WHEN prev = raw_speaker THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, turn_index) AS run
  FROM (SELECT *, lag(raw_speaker) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, turn_index) AS prev FROM turns WHERE end_ms > start_ms)),
cut AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY source_id, run ORDER BY start_ms, end_ms, turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS fresh FROM run),
isle AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id, run ORDER BY start_ms, end_ms, turn_index) AS isle FROM cut),
merged AS (SELECT source_id, raw_speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_turns FROM isle GROUP BY source_id, run, isle, raw_speaker)"""

#: DuckDB: the same by going through each source's turns in order.
MERGE_DUCK = """through AS (SELECT source_id, list([{{'s': raw_speaker, 'a': start_ms, 'b': end_ms, 'n': 1}}] ORDER BY start_ms, end_ms, turn_index) AS l FROM {turns} WHERE end_ms > start_ms GROUP BY source_id),
merged AS (SELECT source_id, m.s AS raw_speaker, m.a AS start_ms, m.b AS end_ms, m.n AS n_turns FROM (SELECT source_id, unnest(list_reduce(l, lambda p, t: CASE WHEN p[-1].s = t[1].s AND t[1].a - p[-1].b <= {gap}
  THEN list_concat(p[1:len(p) - 1], [{{'s': t[1].s, 'a': p[-1].a, 'b': greatest(p[-1].b, t[1].b), 'n': p[-1].n + 1}}]) ELSE list_concat(p, t) END)) AS m FROM through))"""

QUERIES = {
    "valid_turns": Query("SELECT source_id, turn_index, start_ms, end_ms, raw_speaker, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, turn_index) - 1 AS place FROM turns WHERE end_ms > start_ms",
        duck_sql="SELECT source_id, l[i].t AS turn_index, l[i].a AS start_ms, l[i].b AS end_ms, l[i].s AS raw_speaker, i - 1 AS place FROM (SELECT source_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT source_id, list({'t': turn_index, 'a': start_ms, 'b': end_ms, 's': raw_speaker} ORDER BY start_ms, end_ms, turn_index) AS l FROM turns WHERE start_ms < end_ms GROUP BY source_id))"),
    "merge_turns": Query(f"WITH {MERGE.format(gap=550)} SELECT * FROM merged",
        duck_sql=f"WITH {MERGE_DUCK.format(gap=550, turns='turns')} SELECT * FROM merged"),
    "speech_regions": Query("""WITH dur AS (SELECT source_id AS d_id, max(end_ms) + 5000 AS d FROM segments GROUP BY source_id),
pad AS (SELECT source_id, d, greatest(0, start_ms - 350) AS a, least(d, end_ms + 350) AS b FROM segments JOIN dur ON source_id = d_id WHERE trim(text) <> ''),
cut AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY source_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 600 THEN 0 ELSE 1 END AS fresh FROM pad WHERE b > a),
isle AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isle FROM cut),
zone AS (SELECT source_id, d, isle, min(a) AS a, max(b) AS b FROM isle GROUP BY source_id, d, isle),
total AS (SELECT source_id, d AS audio_ms, count(*) AS regions, CAST(sum(b - a) AS BIGINT) AS speech_ms FROM zone GROUP BY source_id, d)
SELECT source_id, audio_ms, regions, speech_ms, round(speech_ms / audio_ms, 6) AS coverage, greatest(0, audio_ms - speech_ms) AS saved_ms,
  CASE WHEN regions < 2 THEN 'una_sola_region' WHEN speech_ms < 8000 THEN 'muy_poca_voz' WHEN 100 * speech_ms >= 88 * audio_ms THEN 'ahorro_insuficiente' ELSE 'ok' END AS reason FROM total""",
        duck_sql="""WITH dur AS (SELECT source_id, max(end_ms) + 5000 AS d FROM segments GROUP BY source_id),
pad AS (SELECT source_id, list([{'a': greatest(0, start_ms - 350), 'b': least(d, end_ms + 350)}] ORDER BY start_ms, end_ms) AS l FROM segments JOIN dur USING (source_id) WHERE trim(text) <> '' AND least(d, end_ms + 350) > greatest(0, start_ms - 350) GROUP BY source_id),
zone AS (SELECT source_id, list_reduce(l, lambda p, t: CASE WHEN t[1].a - p[-1].b <= 600 THEN list_concat(p[1:len(p) - 1], [{'a': p[-1].a, 'b': greatest(p[-1].b, t[1].b)}]) ELSE list_concat(p, t) END) AS z FROM pad),
total AS (SELECT source_id, d AS audio_ms, len(z) AS regions, list_sum(list_transform(z, lambda x: x.b - x.a))::BIGINT AS speech_ms FROM zone JOIN dur USING (source_id))
SELECT source_id, audio_ms, regions, speech_ms, round(speech_ms / audio_ms, 6) AS coverage, greatest(0, audio_ms - speech_ms) AS saved_ms,
  coalesce(list_filter([{'c': regions = 1, 'r': 'una_sola_region'}, {'c': speech_ms < 8000, 'r': 'muy_poca_voz'}, {'c': audio_ms - speech_ms <= 0.12 * audio_ms, 'r': 'ahorro_insuficiente'}], lambda x: x.c)[1].r, 'ok') AS reason FROM total"""),
    "concat_layout": Query("""SELECT source_id, turn_index, start_ms AS original_start, end_ms AS original_end, CAST(at0 AS BIGINT) AS concat_start, CAST(at0 + end_ms - start_ms AS BIGINT) AS concat_end FROM (
  SELECT *, coalesce(sum(end_ms - start_ms + 250) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at0 FROM turns WHERE end_ms > start_ms) x""",
        duck_sql="""WITH v AS (SELECT * FROM turns WHERE end_ms > start_ms)
SELECT a.source_id, a.turn_index, a.start_ms AS original_start, a.end_ms AS original_end, coalesce(sum(b.end_ms - b.start_ms + 250), 0)::BIGINT AS concat_start, (coalesce(sum(b.end_ms - b.start_ms + 250), 0) + a.end_ms - a.start_ms)::BIGINT AS concat_end
FROM v a LEFT JOIN v b ON a.source_id = b.source_id AND (b.start_ms, b.end_ms, b.turn_index) < (a.start_ms, a.end_ms, a.turn_index) GROUP BY a.source_id, a.turn_index, a.start_ms, a.end_ms"""),
    "speaker_gaps": Query("""SELECT source_id, raw_speaker, count(*) AS turns, CAST(coalesce(max(gap), 0) AS BIGINT) AS max_gap_ms FROM (
  SELECT *, greatest(0, lead(start_ms) OVER (PARTITION BY source_id, raw_speaker ORDER BY start_ms, end_ms, turn_index) - end_ms) AS gap FROM turns WHERE end_ms > start_ms) x GROUP BY source_id, raw_speaker""",
        duck_sql="""SELECT source_id, raw_speaker, len(l) AS turns, greatest(0, coalesce(list_max(list_transform(range(1, len(l)), lambda i: l[i + 1].a - l[i].b)), 0))::BIGINT AS max_gap_ms
FROM (SELECT source_id, raw_speaker, list({'a': start_ms, 'b': end_ms} ORDER BY start_ms, end_ms, turn_index) AS l FROM turns WHERE end_ms > start_ms GROUP BY ALL)"""),
    "range_scan_window": Query("SELECT source_id, seg_id, greatest(start_ms, 30000) AS start_ms, least(end_ms, 90000) AS end_ms, text FROM segments WHERE start_ms < 90000 AND end_ms > 30000",
        duck_sql="SELECT source_id, seg_id, list_sort([start_ms, 30000, 90000])[2] AS start_ms, list_sort([end_ms, 30000, 90000])[2] AS end_ms, text FROM segments WHERE least(end_ms, 90000) - greatest(start_ms, 30000) > 0"),
    "sub_windows": Query("""WITH n AS (SELECT source_id, turn_index, start_ms, end_ms, greatest(1, least(6, CAST(floor((end_ms - start_ms) / 1500.0) AS INT))) AS n FROM turns WHERE end_ms - start_ms >= 1500),
w AS (SELECT *, explode(sequence(0, n - 1)) AS k FROM n)
SELECT source_id, turn_index, CAST(k AS INT) AS k, CAST(CASE WHEN n = 1 THEN start_ms + floor((end_ms - start_ms - 1500) / 2.0) ELSE start_ms + floor((end_ms - start_ms - 1500) * k / (n - 1.0)) END AS BIGINT) AS window_start FROM w""",
        duck_sql="""SELECT source_id, turn_index, k::INTEGER AS k, CASE WHEN n = 1 THEN start_ms + (end_ms - start_ms - 1500) // 2 ELSE start_ms + (end_ms - start_ms - 1500) * k // (n - 1) END AS window_start
FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT *, least(6, (end_ms - start_ms) // 1500) AS n FROM turns WHERE (end_ms - start_ms) // 1500 > 0))"""),
}

_PIECES = """piece AS (SELECT source_id, turn_index, start_ms AS o0, at0 AS start_ms, at0 + end_ms - start_ms AS end_ms FROM (
  SELECT *, CAST(coalesce(sum(end_ms - start_ms + 250) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at0 FROM turns WHERE end_ms > start_ms) x)"""
_MERGED_HITS = """run AS (SELECT *, sum(CASE WHEN prev = raw_speaker THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY a, b, raw_speaker ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM (SELECT *, lag(raw_speaker) OVER (PARTITION BY source_id ORDER BY a, b, raw_speaker) AS prev FROM hit) y),
cut AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY source_id, run ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 200 THEN 0 ELSE 1 END AS fresh FROM run),
isle AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id, run ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isle FROM cut)
SELECT source_id, raw_speaker, CAST(min(a) AS BIGINT) AS start_ms, CAST(max(b) AS BIGINT) AS end_ms FROM isle GROUP BY source_id, raw_speaker, run, isle"""
REMAP_ORACLE = """WITH piece AS (SELECT source_id, turn_index, start_ms AS o0, at0 AS c0, at0 + end_ms - start_ms AS c1 FROM (
  SELECT *, coalesce(sum(end_ms - start_ms + 250) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at0 FROM turns WHERE end_ms > start_ms) x),
hit AS (SELECT s.source_id, s.raw_speaker, greatest(s.start_ms, p.c0) - p.c0 + p.o0 AS a, least(s.end_ms, p.c1) - p.c0 + p.o0 AS b
  FROM segments s JOIN piece p ON s.source_id = p.source_id AND s.start_ms < p.c1 AND s.end_ms > p.c0 WHERE least(s.end_ms, p.c1) - greatest(s.start_ms, p.c0) >= 50),
run AS (SELECT *, sum(CASE WHEN prev = raw_speaker THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY a, b, raw_speaker ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM (SELECT *, lag(raw_speaker) OVER (PARTITION BY source_id ORDER BY a, b, raw_speaker) AS prev FROM hit) y),
cut AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY source_id, run ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 200 THEN 0 ELSE 1 END AS fresh FROM run),
isle AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id, run ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isle FROM cut)
SELECT source_id, raw_speaker, CAST(min(a) AS BIGINT) AS start_ms, CAST(max(b) AS BIGINT) AS end_ms FROM isle GROUP BY source_id, raw_speaker, run, isle"""
RATIO_ORACLE = """SELECT a.source_id, a.turn_index, round(least(1.0, coalesce(sum(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) FILTER (b.source_id IS NOT NULL), 0) / max(a.end_ms - a.start_ms)), 6) AS overlap_ratio
FROM turns a LEFT JOIN turns b ON a.source_id = b.source_id AND a.raw_speaker <> b.raw_speaker AND b.end_ms > b.start_ms AND b.start_ms < a.end_ms AND b.end_ms > a.start_ms
WHERE a.end_ms > a.start_ms GROUP BY a.source_id, a.turn_index"""


def region_remap(spark, sf_dir):
    """What was heard in a row of regions laid end to end, put back to where the regions were; a piece under 50 ms is dropped."""
    from turnwise.plans.query import over
    from turnwise.sources import views

    pieces = over(spark, f"WITH {_PIECES} SELECT * FROM piece", {"turns": views.turns(spark, sf_dir)})
    met = bucketed_overlap(views.segments(spark, sf_dir).select("source_id", "start_ms", "end_ms", "raw_speaker"), pieces, "source_id", 60_000)
    a, b, shift = F.greatest("start_ms", "r_start_ms"), F.least("end_ms", "r_end_ms"), F.col("r_o0") - F.col("r_start_ms")
    hits = met.where((b - a >= 50) & (F.col("start_ms") < F.col("r_end_ms")) & (F.col("end_ms") > F.col("r_start_ms"))).select("source_id", "raw_speaker", (a + shift).alias("a"), (b + shift).alias("b"))
    return over(spark, f"WITH {_MERGED_HITS}", {"hit": hits})


def overlap_ratio(turns: DataFrame) -> DataFrame:
    """source_id, turn_index, overlap_ratio of every valid turn: the share of it that turns of other speakers overlap, 1 at most."""
    valid = turns.where("end_ms > start_ms")
    met = bucketed_overlap(valid, valid.select("source_id", "start_ms", "end_ms", "raw_speaker"), "source_id", 60_000).where("raw_speaker <> r_raw_speaker")
    sums = met.groupBy("source_id", "turn_index").agg(F.sum(F.greatest(F.lit(0), F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms"))).alias("o"))
    share = F.least(F.lit(1.0), F.coalesce("o", F.lit(0)) / (F.col("end_ms") - F.col("start_ms")))
    return valid.join(sums, ["source_id", "turn_index"], "left").select("source_id", "turn_index", F.round(share, 6).alias("overlap_ratio"))


def overlap_ratio_query(spark, sf_dir):
    from turnwise.sources import views

    return overlap_ratio(views.turns(spark, sf_dir))


OWN = {"region_remap": (region_remap, REMAP_ORACLE), "overlap_ratio": (overlap_ratio_query, RATIO_ORACLE)}
