"""Stage times, performance and outcomes of jobs."""

from __future__ import annotations

from turnwise.plans.query import Query

QUERIES = {
    "pass_timing_rollup": Query("""SELECT user_id AS job_id, count(*) AS passes, CAST(sum(CASE WHEN event_type = 'click' THEN c ELSE 0 END) AS BIGINT) AS segmentation_cs, CAST(sum(CASE WHEN event_type = 'view' THEN c ELSE 0 END) AS BIGINT) AS embedding_cs,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN c ELSE 0 END) AS BIGINT) AS clustering_cs, CAST(sum(greatest(0, c)) AS BIGINT) AS wall_cs, bool_or(event_type = 'error') AS any_error FROM (SELECT user_id, event_type, CAST(floor(value * 100) AS BIGINT) AS c FROM events) e GROUP BY user_id""",
        duck_sql="""SELECT user_id AS job_id, count(*) AS passes, coalesce(sum(c) FILTER (event_type = 'click'), 0)::BIGINT AS segmentation_cs, coalesce(sum(c) FILTER (event_type = 'view'), 0)::BIGINT AS embedding_cs,
  coalesce(sum(c) FILTER (event_type = 'purchase'), 0)::BIGINT AS clustering_cs, coalesce(sum(c) FILTER (c > 0), 0)::BIGINT AS wall_cs, list_contains(list(event_type), 'error') AS any_error FROM (SELECT *, floor(value * 100)::BIGINT AS c FROM events) GROUP BY user_id"""),
    "latest_progress": Query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) e WHERE r = 1",
        duck_sql="""SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events SEMI JOIN (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id) USING (user_id, ts) GROUP BY user_id"""),
    "progress_eta": Query("""SELECT event_id, CASE WHEN p <= 0 OR t <= 0 THEN NULL WHEN p >= 100 THEN 0.0 ELSE round(t / (p / 100.0) - t, 6) END AS eta FROM (SELECT event_id, CAST(event_id % 111 AS DOUBLE) AS p, CAST(event_id % 37 AS DOUBLE) AS t FROM events) e""",
        duck_sql="""SELECT event_id, CASE WHEN event_id % 111 > 0 AND event_id % 37 > 0 THEN round(greatest(0, 100 - event_id % 111) * (event_id % 37) / (event_id % 111), 6) END AS eta FROM events"""),
    "mru_history": Query("""SELECT user_id, event_type, place FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, event_type) AS place FROM (SELECT user_id, event_type, max(event_id) AS last FROM events GROUP BY user_id, event_type) a) b WHERE place <= 10""",
        duck_sql="""SELECT user_id, l[i].t AS event_type, i AS place FROM (SELECT user_id, l, unnest(range(1, least(10, len(l)) + 1)) AS i FROM (SELECT user_id, list({'t': event_type} ORDER BY last DESC, event_type) AS l FROM (SELECT user_id, event_type, max(event_id) AS last FROM events GROUP BY ALL) GROUP BY user_id))"""),
    "debounce_last": Query("""SELECT user_id, event_id, event_type FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) e WHERE next IS NULL OR next > ts + INTERVAL '5' MINUTE""",
        duck_sql="""SELECT user_id, event_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.ts <= e.ts + INTERVAL 5 MINUTE AND (f.ts > e.ts OR (f.ts = e.ts AND f.event_id > e.event_id)))"""),
    "revision_history": Query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision, nullif(event_type, first) AS edited FROM (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first FROM events) e""",
        duck_sql="""SELECT user_id, l[i].e AS event_id, i AS revision, CASE WHEN l[i].t <> l[1].t THEN l[i].t END AS edited FROM (SELECT user_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT user_id, list({'e': event_id, 't': event_type} ORDER BY ts, event_id) AS l FROM events GROUP BY user_id))"""),
    "peak_level": Query("SELECT user_id, CAST(floor(event_id / 512.0) AS BIGINT) AS block, max(abs(value - 50)) AS peak FROM events GROUP BY user_id, CAST(floor(event_id / 512.0) AS BIGINT)",
        duck_sql="""SELECT user_id, event_id // 512 AS block, greatest(max(value) - 50, 50 - min(value)) AS peak FROM events GROUP BY ALL"""),
    "drop_leading": Query("""SELECT user_id, event_id, CAST(before AS BIGINT) AS before_ms FROM (SELECT *, coalesce(sum(32) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events) e WHERE before >= 120""",
        duck_sql="""SELECT user_id, l[i] AS event_id, 32 * (i - 1) AS before_ms FROM (SELECT user_id, l, unnest(range(5, len(l) + 1)) AS i FROM (SELECT user_id, list(event_id ORDER BY ts, event_id) AS l FROM events GROUP BY user_id))"""),
}
