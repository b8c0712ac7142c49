"""What depends on order inside one small group: label smoothing, wrapping, edit similarity."""

from __future__ import annotations

import difflib
import textwrap
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.sources import views


def smoothed(labels: list, starts: list, ends: list, least_words: int = 2, least_ms: int = 350) -> list:
    """Inner runs between equal neighbours that are short in words or in time take the neighbours' label, the leftmost first.

    One pass: a run is complete when the next one begins. Joining it with its neighbours changes no label before it and
    leaves the run before it as it was, so that nothing to the left needs another look."""
    runs: list[list] = []
    for i, label in enumerate(labels):
        if runs and runs[-1][0] == label:
            runs[-1][2] = i + 1
            continue
        runs.append([label, i, i + 1])
        if len(runs) > 2 and label is not None and runs[-3][0] == label:
            _, b, c = runs[-2]
            if c - b < least_words or max(0, ends[c - 1] - starts[b]) < least_ms:
                runs[-3:] = [[label, runs[-3][1], i + 1]]
    return [label for label, a, b in runs for _ in range(b - a)]


@F.arrow_udf(T.ArrayType(T.LongType()))
def _smooth(words: pa.Array) -> pa.Array:
    return pa.array([smoothed([w["label"] for w in ws], [w["start_ms"] for w in ws], [w["end_ms"] for w in ws]) for ws in words.to_pylist()], pa.list_(pa.int64()))


def label_smoothing(words: DataFrame) -> DataFrame:
    """words (source_id, seg_id, word_idx, start_ms, end_ms, label) with the label smoothed within each segment. A segment's words
    are gathered by themselves, so that a long source is as many groups as it has segments; all other columns are kept."""
    ids, own = ["source_id", "seg_id"], [c for c in words.columns if c not in ("source_id", "seg_id", "word_idx")]
    row = F.struct("word_idx", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), F.col("label").cast("long").alias("label"), F.struct(*own).alias("own"))
    held = words.groupBy(*ids).agg(F.array_sort(F.collect_list(row)).alias("w"))
    held = held.withColumn("l", _smooth(F.transform("w", lambda x: F.struct(x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["label"].alias("label")))))
    each = held.select(*ids, F.posexplode("w").alias("k", "x"), "l")
    return each.select(*ids, "x.word_idx", *(F.col(f"x.own.{c}").alias(c) for c in own if c != "label"), F.get("l", F.col("k")).alias("label"))


#: DuckDB: the runs of lab (source_id, seg_id, word_idx, start_ms, end_ms, label) smoothed one join at a time, from the start again
#: after each; smooth has a row a word. Part of a WITH RECURSIVE.
_BRIEF = "list_filter(range(2, len({r})), lambda i: {r}[i - 1].l = {r}[i + 1].l AND ({r}[i].n < 2 OR greatest(0, {r}[i].b - {r}[i].a) < 350))[1]"
SMOOTH_DUCK = f"""cuts AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id, seg_id ORDER BY word_idx) AS run FROM (
  SELECT *, CASE WHEN row_number() OVER k > 1 AND lag(label) OVER k IS NOT DISTINCT FROM label THEN 0 ELSE 1 END AS fresh FROM lab WINDOW k AS (PARTITION BY source_id, seg_id ORDER BY word_idx))),
runs0 AS (SELECT source_id, seg_id, list({{'l': label, 'n': n, 'a': a, 'b': b}} ORDER BY run) AS runs FROM (SELECT source_id, seg_id, run, label, count(*) AS n, arg_min(start_ms, word_idx) AS a, arg_max(end_ms, word_idx) AS b FROM cuts GROUP BY ALL) GROUP BY ALL),
joined AS (SELECT source_id, seg_id, runs, {_BRIEF.format(r='runs')} AS i FROM runs0
  UNION ALL SELECT source_id, seg_id, runs, {_BRIEF.format(r='runs')} FROM (
    SELECT source_id, seg_id, list_concat(list_concat(runs[1:i - 2], [{{'l': runs[i - 1].l, 'n': runs[i - 1].n + runs[i].n + runs[i + 1].n, 'a': runs[i - 1].a, 'b': runs[i + 1].b}}]), runs[i + 2:]) AS runs FROM joined WHERE i IS NOT NULL)),
spread AS (SELECT source_id, seg_id, flatten(list_transform(runs, lambda r: list_transform(range(r.n), lambda k: r.l))) AS ls FROM joined WHERE i IS NULL),
smooth AS (SELECT c.source_id, c.seg_id, c.word_idx, c.start_ms, c.end_ms, ls[row_number() OVER (PARTITION BY c.source_id, c.seg_id ORDER BY c.word_idx)] AS label FROM cuts c JOIN spread USING (source_id, seg_id))"""


def label_smoothing_query(spark, sf_dir):
    label = F.when(F.col("word_idx") % 7 == 3, 1).otherwise(F.floor(F.col("word_idx") / 11) % 3).cast("long")
    return label_smoothing(views.words(spark, sf_dir).withColumn("label", label)).select("source_id", "seg_id", "word_idx", "label")


LABELS_ORACLE = f"""WITH RECURSIVE lab AS (SELECT source_id, seg_id, word_idx, start_ms, end_ms, CASE WHEN word_idx % 7 = 3 THEN 1 ELSE word_idx // 11 % 3 END::BIGINT AS label FROM words),
{SMOOTH_DUCK}
SELECT source_id, seg_id, word_idx, label FROM smooth"""


def text_similarity_query(spark, sf_dir):
    """Ratio of matching blocks between neighbouring sentences of a source, lower-cased and with white space collapsed."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        clean = lambda t: " ".join((t or "").lower().split())
        return pd.Series([round(difflib.SequenceMatcher(None, clean(x), clean(y)).ratio(), 6) for x, y in zip(a, b, strict=True)])

    s = views.segments(spark, sf_dir)
    nxt = s.select(F.col("source_id").alias("n_source"), (F.col("seg_id") - 1).alias("n_seg"), F.col("text").alias("n_text"))
    pairs = s.join(nxt, (F.col("source_id") == F.col("n_source")) & (F.col("seg_id") == F.col("n_seg")))
    return pairs.select("source_id", "seg_id", ratio("text", "n_text").alias("similarity"))


def wrapped(text: Column, width: int = 100) -> Column:
    """text with its lines cut at blanks so that they hold at most width characters; a longer word has a line of its own.

    Each match takes as many whole words as fit, or one long word, and the blanks behind them; what is left after the last one
    fits. Blanks before a line go, those inside it stay, lines of white space only are kept as they are. Null stays null."""
    lines = rf"\G((?>(?s:[^ ].{{0,{width - 1}}})(?= |\z)|[^ ]+)) +"
    one = lambda line: F.when(F.trim(F.regexp_replace(line, r"(?U)[\s\x1c-\x1f]", " ")) == "", line).otherwise(F.regexp_replace(F.ltrim(line), lines, "$1\n"))
    return F.array_join(F.transform(F.split(text, "\n", -1), one), "\n", "")


def wrap_text_query(spark, sf_dir):
    return views.texts(spark, sf_dir).select("kind", "id", wrapped(F.col("text")).alias("text"))


#: Word by word: a word that doesn't fit behind what the line holds begins a new one.
_LINE = """list_reduce(list_transform(string_split(line, ' '), lambda w: {'done': '', 'now': w}), lambda s, w: CASE WHEN s.now = '' THEN {'done': s.done, 'now': w.now}
  WHEN length(s.now) + 1 + length(w.now) > 100 THEN {'done': s.done || s.now || chr(10), 'now': w.now} ELSE {'done': s.done, 'now': s.now || ' ' || w.now} END)"""
WRAP_ORACLE = f"""WITH cut AS (SELECT kind, id, unnest(range(0, len(l))) AS i, l FROM (SELECT kind, id, string_split(text, chr(10)) AS l FROM texts)),
folded AS (SELECT kind, id, i, line, {_LINE} AS f FROM (SELECT kind, id, i, l[i + 1] AS line FROM cut))
SELECT kind, id, string_agg(CASE WHEN trim(regexp_replace(line, '\\s', ' ', 'g')) = '' THEN line ELSE f.done || f.now END, chr(10) ORDER BY i) AS text FROM folded GROUP BY kind, id
UNION ALL SELECT kind, id, NULL FROM texts WHERE text IS NULL"""


#: Texts that are held as Python's strings at once.
FEW_TEXTS = 64


@F.arrow_udf(T.StringType())
def filled(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """text with its paragraphs filled to 100 characters, cut behind hyphens and inside words that are longer; those of white space
    only are empty, null stays null. The rules for hyphens and dashes are those of Python's textwrap. Results leave a few texts
    at a time, so that a task holds one batch of input and little more."""
    fill = lambda t: "\n".join(textwrap.fill(p, 100) if p.strip() else "" for p in t.splitlines() or [t])
    for batch in texts:
        for at in range(0, len(batch), FEW_TEXTS):
            yield pa.array([None if t is None else fill(t) for t in batch.slice(at, FEW_TEXTS).to_pylist()], pa.string())


def fill_text_query(spark, sf_dir):
    return views.texts(spark, sf_dir).select("kind", "id", filled("text").alias("text"))


OWN = {
    "label_smoothing": (label_smoothing_query, LABELS_ORACLE), "text_similarity": (text_similarity_query, None),
    "wrap_text": (wrap_text_query, WRAP_ORACLE), "fill_text": (fill_text_query, None),
}
