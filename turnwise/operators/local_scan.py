"""Changes of speaker inside long turns: three windows probe a turn, six scan it if they don't agree, and runs of windows that
another voice explains better are cut out.

Vectors of windows come as tables; all steps are joins with the few prototypes of a source, and gaps and islands over windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.operators.identity import _VOICED, _Dialect, prototypes, scan_candidates
from turnwise.plans.query import over
from turnwise.plans.shared import written
from turnwise.sources import views

#: Windows of a scan, how long each is, and the least piece of a turn, in milliseconds.
WINDOWS, PROBES, WINDOW_MS, PIECE_MS = 6, 3, 2500, 400


def _parts(d: _Dialect) -> tuple[str, str, str]:
    """Three parts that end in p (prototypes), label (windows of suspect turns) and out (source_id, turn_index, start_ms, end_ms, speaker, change), from held (turns), elig, probes and windows.

    Labels: -1 for a voice that no prototype explains, -2 where a window has no vector. change: moved, new, or null."""
    protos = f"""trusted AS (SELECT source_id, turn_index, start_ms, end_ms, speaker, embedding FROM held t WHERE end_ms - start_ms >= 800 AND end_ms - start_ms < 18000 AND embedding IS NOT NULL),
{d.prototypes('p', 'trusted')}"""
    labels = f"""probed AS (SELECT w.source_id, w.turn_index, w.k, w.embedding, t.speaker FROM probes w JOIN elig e ON w.source_id = e.source_id AND w.turn_index = e.turn_index JOIN held t ON t.source_id = w.source_id AND t.turn_index = w.turn_index WHERE w.embedding IS NOT NULL),
near AS (SELECT a.source_id, a.turn_index, count(*) AS n, count(p.speaker) AS sims, min({d.sim('a.embedding', 'p.proto')}) AS lowest FROM probed a LEFT JOIN p p ON a.source_id = p.source_id AND a.speaker = p.speaker GROUP BY a.source_id, a.turn_index),
alike AS (SELECT a.source_id, a.turn_index, median({d.sim('a.embedding', 'b.embedding')}) AS mutual FROM probed a JOIN probed b ON a.source_id = b.source_id AND a.turn_index = b.turn_index AND a.k < b.k GROUP BY a.source_id, a.turn_index),
same AS (SELECT near.source_id, near.turn_index FROM near LEFT JOIN alike ON near.source_id = alike.source_id AND near.turn_index = alike.turn_index WHERE n >= 2 AND ((sims >= 2 AND lowest >= 0.58) OR mutual >= 0.62)),
detailed AS (SELECT e.source_id, e.turn_index FROM elig e LEFT JOIN same s ON e.source_id = s.source_id AND e.turn_index = s.turn_index WHERE s.source_id IS NULL),
w AS (SELECT x.source_id, x.turn_index, x.k, x.start_ms AS a, x.end_ms AS b, x.embedding, t.speaker, t.start_ms, t.end_ms FROM windows x JOIN detailed e ON x.source_id = e.source_id AND x.turn_index = e.turn_index JOIN held t ON t.source_id = x.source_id AND t.turn_index = x.turn_index),
own AS (SELECT w.source_id, w.turn_index, w.k, {d.sim('w.embedding', 'p.proto')} AS cur FROM w JOIN p p ON w.source_id = p.source_id AND w.speaker = p.speaker),
other AS (SELECT w.source_id, w.turn_index, w.k, p.speaker AS sp, {d.sim('w.embedding', 'p.proto')} AS sim FROM w JOIN p p ON w.source_id = p.source_id AND w.speaker <> p.speaker),
rival AS (SELECT source_id, turn_index, k, sp, sim FROM (SELECT *, row_number() OVER (PARTITION BY source_id, turn_index, k ORDER BY sim DESC, sp DESC) AS r FROM other) x WHERE r = 1),
label AS (SELECT w.*, CASE WHEN embedding IS NULL THEN -2 WHEN sp IS NOT NULL AND sim >= 0.58 AND sim - coalesce(cur, -1.0) >= 0.15 AND coalesce(cur, -1.0) <= 0.50 THEN sp
  WHEN cur IS NOT NULL AND cur <= 0.35 AND coalesce(sim, -1.0) < 0.45 THEN -1 WHEN cur IS NULL AND coalesce(sim, -1.0) < 0.45 THEN -1 ELSE w.speaker END AS label
  FROM w LEFT JOIN own o ON w.source_id = o.source_id AND w.turn_index = o.turn_index AND w.k = o.k LEFT JOIN rival r ON w.source_id = r.source_id AND w.turn_index = r.turn_index AND w.k = r.k)"""
    pieces = f"""cut AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY source_id, turn_index ORDER BY k) = label THEN 0 ELSE 1 END AS fresh FROM label),
isle AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id, turn_index ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM cut),
runs AS (SELECT source_id, turn_index, run, label, speaker, start_ms, end_ms, min(a) AS a, max(b) AS b FROM isle WHERE label <> speaker AND label <> -2 GROUP BY source_id, turn_index, run, label, speaker, start_ms, end_ms HAVING count(*) >= 2),
agree AS (SELECT x.source_id, x.turn_index, x.run, median({d.sim('x.embedding', 'y.embedding')}) AS mutual FROM isle x JOIN isle y ON x.source_id = y.source_id AND x.turn_index = y.turn_index AND x.run = y.run AND x.k < y.k AND x.label = -1 GROUP BY x.source_id, x.turn_index, x.run),
fit AS (SELECT r.*, r.label <> -1 OR (coalesce(mutual, 1.0) >= 0.55 AND r.b - r.a >= 2500) AS ok FROM runs r LEFT JOIN agree g ON r.source_id = g.source_id AND r.turn_index = g.turn_index AND r.run = g.run),
top AS (SELECT source_id AS top_id, max(speaker) AS top FROM held t GROUP BY source_id),
given AS (SELECT f.*, CASE WHEN label <> -1 THEN label ELSE top + sum(CASE WHEN ok AND label = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY turn_index, run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS target,
  coalesce(lag(b) OVER (PARTITION BY source_id, turn_index ORDER BY run), start_ms) AS place FROM fit f JOIN top ON source_id = top_id),
ends AS (SELECT source_id, turn_index, speaker, end_ms, max(b) AS b FROM given GROUP BY source_id, turn_index, speaker, end_ms),
out AS (SELECT source_id, turn_index, place AS start_ms, a AS end_ms, speaker, NULL AS change FROM given WHERE a - place >= 400
  UNION ALL SELECT source_id, turn_index, a, b, CAST(target AS INT), CASE WHEN label = -1 THEN 'new' ELSE 'moved' END FROM given WHERE ok
  UNION ALL SELECT source_id, turn_index, place, b, speaker, NULL FROM given WHERE NOT ok AND b - place >= 400
  UNION ALL SELECT source_id, turn_index, b, end_ms, speaker, NULL FROM ends WHERE end_ms - b >= 400
  UNION ALL SELECT t.source_id, t.turn_index, t.start_ms, t.end_ms, t.speaker, NULL FROM held t LEFT JOIN ends e ON t.source_id = e.source_id AND t.turn_index = e.turn_index WHERE e.source_id IS NULL)"""
    return protos, labels, pieces


def scanned(turns: DataFrame) -> DataFrame:
    """The turns that a scan looks at: source_id, turn_index, place."""
    return scan_candidates(turns.select("source_id", "turn_index", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), F.col("speaker").alias("raw_speaker")))


def local_change_scan(turns: DataFrame, probes: DataFrame, windows: DataFrame) -> DataFrame:
    """turns (source_id, turn_index, start_ms, end_ms double, speaker int, embedding or null) cut where another voice speaks in
    two windows or more: source_id, turn_index, start_ms, end_ms, speaker, change.

    probes and windows: source_id, turn_index, k, start_ms, end_ms, embedding; only those of scanned turns are read. Only the four
    longest turns of 18 s and more of a source are looked at, of those that others overlap by 15 % at most. New voices get numbers
    after the source's last."""
    turns = written(turns, "turns")
    return _scan(turns, written(scanned(turns), "elig"), probes, windows)


def _scan(turns: DataFrame, elig: DataFrame, probes: DataFrame, windows: DataFrame) -> DataFrame:
    spark = turns.sparkSession
    tables = {"held": turns, "elig": elig, "probes": probes, "windows": windows}
    _, labels, pieces = _parts(_Dialect(True))
    # Read many times by what follows.
    tables["p"] = written(prototypes(turns.where(_VOICED)), "prototypes")
    tables["label"] = written(over(spark, f"WITH {labels} SELECT * FROM label", tables), "labels")
    return over(spark, f"WITH {pieces} SELECT * FROM out", tables)


_PLACES = "(SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) kk"
#: The test data has no audio: a window takes the vector of a turn of its source, two windows in a row that of the same one.
_WINDOWS = f"""sizes AS (SELECT source_id AS n_id, count(*) AS n FROM turn_embeddings GROUP BY source_id),
t AS (SELECT source_id, turn_index, CAST(start_ms AS DOUBLE) AS start_ms, CAST(end_ms AS DOUBLE) AS end_ms, speaker, embedding FROM turn_embeddings),
long AS (SELECT t.source_id, t.turn_index, t.start_ms, t.end_ms, n FROM t JOIN sizes ON source_id = n_id WHERE t.end_ms - t.start_ms >= 18000),
windows AS (SELECT l.source_id, l.turn_index, k, l.start_ms + (l.end_ms - l.start_ms - 2500) * k / 5.0 AS start_ms, l.start_ms + (l.end_ms - l.start_ms - 2500) * k / 5.0 + 2500 AS end_ms, v.embedding FROM long l JOIN {_PLACES} ON true JOIN t v ON v.source_id = l.source_id AND v.turn_index = (l.turn_index + 1 + CAST(floor(k / 2.0) AS BIGINT)) % l.n),
probes AS (SELECT l.source_id, l.turn_index, k, l.start_ms + (l.end_ms - l.start_ms - 2500) * k / 2.0 AS start_ms, l.start_ms + (l.end_ms - l.start_ms - 2500) * k / 2.0 + 2500 AS end_ms, v.embedding FROM long l JOIN {_PLACES} ON k < 3 JOIN t v ON v.source_id = l.source_id AND v.turn_index = (l.turn_index + 1 + k) % l.n)"""
_OUT = "SELECT source_id, turn_index, round(start_ms, 3) AS start_ms, round(end_ms, 3) AS end_ms, speaker, change FROM out"


#: Windows are made for the turns that are looked at, not for all long ones.
_FEW = _WINDOWS.replace("FROM t JOIN sizes", "FROM t LEFT SEMI JOIN elig e ON t.source_id = e.source_id AND t.turn_index = e.turn_index JOIN sizes")


def local_change_scan_query(spark, sf_dir):
    held = written(views.turn_embeddings(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in ("start_ms", "end_ms")}), "turns")
    tables = {"turn_embeddings": held, "elig": written(scanned(held), "elig")}
    made = {n: over(spark, f"WITH {_FEW} SELECT * FROM {n}", tables) for n in ("probes", "windows")}
    out = _scan(held, tables["elig"], made["probes"], made["windows"])
    return out.select("source_id", "turn_index", F.round("start_ms", 3).alias("start_ms"), F.round("end_ms", 3).alias("end_ms"), "speaker", "change")


ORACLE = f"""WITH {_WINDOWS}, held AS (SELECT * FROM t),
elig AS (SELECT source_id, turn_index FROM (SELECT source_id, turn_index, row_number() OVER (PARTITION BY source_id ORDER BY end_ms - start_ms DESC, turn_index) AS r FROM long) x WHERE r <= 4),
{", ".join(_parts(_Dialect(False)))} {_OUT}"""
OWN = {"local_change_scan": (local_change_scan_query, ORACLE)}
