"""Overlapping chunks of a long recording, ownership of what two of them hear, and tokens joined to words."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions.scalars import word_text
from turnwise.plans.query import Query, over
from turnwise.sources import views

#: Runs of words of one speaker inside a segment; words without bounds are no words.
_RUNS = """l AS (SELECT *, CAST(floor((seg_id + word_idx) / 4.0) AS BIGINT) % 3 AS label FROM words WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL),
c AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY source_id, seg_id ORDER BY word_idx) = label THEN 0 ELSE 1 END AS fresh FROM l),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id, seg_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM c)"""


def segment_texts(spark, sf_dir):
    """The pieces of split segments with their text, from tokens with a leading blank in even sources and bare ones in odd ones."""
    tokens = "transform(array_sort(collect_list(struct(word_idx, word))), x -> CASE WHEN source_id % 2 = 0 THEN concat(' ', x.word) ELSE x.word END)"
    runs = over(spark, f"WITH {_RUNS} SELECT source_id, seg_id, CAST(grp AS BIGINT) AS grp, label AS speaker_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, {tokens} AS tokens FROM g GROUP BY source_id, seg_id, grp, label", {"words": views.words(spark, sf_dir)})
    return runs.withColumn("text", word_text(F.col("tokens"))).drop("tokens")


OWN = {
    "segment_texts": (segment_texts, f"""WITH {_RUNS} SELECT source_id, seg_id, grp::BIGINT AS grp, label AS speaker_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, trim(regexp_replace(string_agg(word, ' ' ORDER BY word_idx), '\\s+', ' ', 'g')) AS text FROM g GROUP BY source_id, seg_id, grp, label"""),
}

QUERIES = {
    "chunk_plan": Query("""WITH d AS (SELECT source_id, max(end_ms) AS dur FROM segments GROUP BY source_id)
SELECT source_id, dur, CASE WHEN dur > 300000 THEN CAST(greatest(1, ceil(greatest(0, dur - 2000) / 88000.0)) AS BIGINT) ELSE 1 END AS chunks FROM d""",
        duck_sql="SELECT source_id, max(end_ms) AS dur, CASE WHEN max(end_ms) > 300000 THEN len(range(0, max(end_ms) - 2000, 88000)) ELSE 1 END AS chunks FROM segments GROUP BY source_id"),
    "chunk_dedupe": Query("""WITH n AS (SELECT source_id AS n_id, max(chunk_idx) AS last FROM chunk_segments GROUP BY source_id),
m AS (SELECT *, chunk_start_ms + local_start_ms + CAST(floor(greatest(0, local_end_ms - local_start_ms) / 2.0) AS BIGINT) AS mid FROM chunk_segments JOIN n ON source_id = n_id)
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY chunk_start_ms + local_start_ms, seg_id) - 1 AS id, seg_id, chunk_idx, chunk_start_ms + local_start_ms AS start_ms, chunk_start_ms + local_end_ms AS end_ms, text
FROM m WHERE (chunk_idx = 0 OR mid >= chunk_start_ms + 1000) AND (chunk_idx = last OR mid < chunk_start_ms + 89000)""",
        # The window that owns a segment, from its middle alone.
        duck_sql="""WITH n AS (SELECT source_id, max(chunk_idx) AS last FROM chunk_segments GROUP BY source_id),
o AS (SELECT s.source_id, s.seg_id, s.start_ms, s.end_ms, s.text, least(last, greatest(0, floor((start_ms + greatest(0, end_ms - start_ms) // 2 - 1000) / 88000)))::BIGINT AS own FROM segments s JOIN n USING (source_id))
SELECT o.source_id, row_number() OVER (PARTITION BY o.source_id ORDER BY o.start_ms, o.seg_id) - 1 AS id, o.seg_id, chunk_idx, o.start_ms, o.end_ms, o.text FROM o JOIN chunk_segments c ON c.source_id = o.source_id AND c.seg_id = o.seg_id AND chunk_idx = own"""),
    # Tokens of three letters, the first of a word with its leading blank; a blank before a token ends the word before it.
    "token_to_word": Query("""WITH p AS (SELECT source_id, seg_id, word_idx, start_ms, end_ms, word, explode(sequence(0, CAST(floor(greatest(length(word) - 1, 0) / 3.0) AS INT))) AS k FROM words),
t AS (SELECT source_id, seg_id, word_idx * 1000L + k AS at, start_ms, end_ms, concat(CASE WHEN k = 0 THEN ' ' ELSE '' END, substring(word, 3 * k + 1, 3)) AS token FROM p),
g AS (SELECT *, sum(CASE WHEN startswith(token, ' ') THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, seg_id ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM t),
w AS (SELECT source_id, seg_id, run, min(start_ms) AS start_ms, max(end_ms) AS end_ms, trim(array_join(transform(array_sort(collect_list(struct(at, token))), x -> x.token), '')) AS word FROM g WHERE trim(token) <> '' GROUP BY source_id, seg_id, run)
SELECT source_id, seg_id, CAST(row_number() OVER (PARTITION BY source_id, seg_id ORDER BY run) AS BIGINT) AS grp, start_ms, end_ms, word FROM w""",
        duck_sql="SELECT source_id, seg_id, row_number() OVER (PARTITION BY source_id, seg_id ORDER BY word_idx) AS grp, start_ms, end_ms, word FROM words WHERE word <> ''"),
    "label_fill": Query("""WITH l AS (SELECT source_id, seg_id, word_idx, CASE WHEN word_idx % 4 IN (1, 2) THEN NULL ELSE (seg_id + word_idx) % 3 END AS label FROM words)
SELECT source_id, seg_id, word_idx, coalesce(label, first_value(label) IGNORE NULLS OVER n, last_value(label) IGNORE NULLS OVER p) AS label FROM l
WINDOW n AS (PARTITION BY source_id, seg_id ORDER BY word_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), p AS (PARTITION BY source_id, seg_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        duck_sql="""WITH l AS (SELECT source_id, seg_id, word_idx, CASE WHEN word_idx % 4 NOT IN (1, 2) THEN (seg_id + word_idx) % 3 END AS own FROM words), k AS (SELECT * FROM l WHERE own IS NOT NULL),
a AS (SELECT l.*, k.own AS after FROM l ASOF LEFT JOIN k ON l.source_id = k.source_id AND l.seg_id = k.seg_id AND l.word_idx <= k.word_idx)
SELECT a.source_id, a.seg_id, a.word_idx, coalesce(after, k.own) AS label FROM a ASOF LEFT JOIN k ON a.source_id = k.source_id AND a.seg_id = k.seg_id AND a.word_idx >= k.word_idx"""),
    "segment_split": Query(f"""WITH {_RUNS},
s AS (SELECT source_id, seg_id, grp, label, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS words FROM g GROUP BY source_id, seg_id, grp, label)
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY seg_id, grp) - 1 AS id, seg_id AS source_segment_id, label AS speaker_id, start_ms, end_ms, words FROM s""",
        duck_sql="""WITH l AS (SELECT *, (seg_id + word_idx) // 4 % 3 AS label FROM words),
i AS (SELECT *, row_number() OVER (PARTITION BY source_id, seg_id ORDER BY word_idx) - row_number() OVER (PARTITION BY source_id, seg_id, label ORDER BY word_idx) AS isle FROM l),
s AS (SELECT source_id, seg_id, label, min(word_idx) AS first_idx, arg_min(start_ms, word_idx) AS start_ms, arg_max(end_ms, word_idx) AS end_ms, count(*) AS words FROM i GROUP BY source_id, seg_id, label, isle)
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY seg_id, first_idx) - 1 AS id, seg_id AS source_segment_id, label AS speaker_id, start_ms, end_ms, words FROM s"""),
}
