"""Ranked lexical search: variable-block-max WAND over shards of postings."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.common import written

#: Postings of a shard, and items in a block of the query set (each block reads the texts again).
SHARD_POSTINGS, QUERY_BLOCK = 1 << 20, 5000
#: Blocks of postings end at every GRAIN-th posting only, hold WIDEST grains at most, and cost as much as BLOCK_COST postings whose
#: bound is wrong by the list's greatest impact.
GRAIN, WIDEST, BLOCK_COST = 8, 32, 4
#: Fixed values of the scoring rule: b in percent, scales of tf and of the weights.
_B, _TF, _K, _WEIGHT = 75, 1_000_000_000, 8, 1000

#: Bytes outside of terms become blanks: terms are runs of ASCII letters and digits and of all that isn't ASCII.
_CLEAN = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """A text's terms as UTF-8, only A-Z lower-cased. Null has none."""
    return (text or "").encode().lower().translate(_CLEAN).split(b" ") if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(_WEIGHT * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """A posting's part of the score, which its term's weight multiplies."""
    m = 100 - _B + (_B * n * n_docs) // total
    return (_TF * tf) // (1000 * tf + _K * m)


def postings(docs: DataFrame, wanted: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs of every document with a term: its number of terms, and which of the wanted it holds how often."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, n, ids, tfs = [], [], [], []
            for row, text in enumerate(b["text"]):
                found = [t for t in terms(text.as_py()) if t]
                if found:
                    held = Counter(filter(wanted.__contains__, found))
                    keep.append(row)
                    n.append(len(found))
                    ids.append([wanted[t] for t in held])
                    tfs.append(list(held.values()))
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


def block_ends(lists: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first postings, last postings + 1) of the blocks of all lists, in order; list k has the postings lists[k] to lists[k + 1].

    Dynamic programming over the grains of a list: the best cut up to a grain is the best cut up to an earlier one and a block from
    there, whose error is its postings times its greatest impact, less their impacts (a constant). All lists go step by step together."""
    sizes = np.diff(lists)
    grains = -(-sizes // GRAIN)
    order = np.argsort(-grains, kind="stable")
    grains, sizes, starts = grains[order], sizes[order], lists[:-1][order]
    if not len(grains):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = int(grains[0])
    greatest = np.maximum.reduceat(impact, lists[:-1])[order]
    best = np.zeros((most + 1, len(grains)), np.int64)
    choice = np.zeros((most + 1, len(grains)), np.int8)
    run = np.zeros((WIDEST, len(grains)), np.int64)
    active = np.searchsorted(-grains, -np.arange(most + 1), side="right")
    for i in range(1, most + 1):
        a, w = int(active[i]), min(i, WIDEST)
        low = starts[:a] + (i - 1) * GRAIN
        high = starts[:a] + np.minimum(sizes[:a], i * GRAIN)
        top = impact[low]
        for k in range(1, GRAIN):
            top = np.maximum(top, impact[np.minimum(low + k, high - 1)])
        run[1:w, :a] = run[: w - 1, :a].copy()
        run[0, :a] = 0
        np.maximum(run[:w, :a], top, out=run[:w, :a])
        count = (high - low) + GRAIN * np.arange(w)[:, None]
        cost = best[i - w : i, :a][::-1] + count * run[:w, :a]
        pick = np.argmin(cost, axis=0)
        choice[i, :a] = pick + 1
        best[i, :a] = cost[pick, np.arange(a)] + BLOCK_COST * greatest[:a]
    at, column, first, last = grains.copy(), np.arange(len(grains)), [], []
    while len(at):
        back = at - choice[at, column]
        first.append(starts[column] + back * GRAIN)
        last.append(starts[column] + np.minimum(sizes[column], at * GRAIN))
        left = back > 0
        at, column = back[left], column[left]
    first, last = np.concatenate(first), np.concatenate(last)
    order = np.argsort(first)
    return first[order], last[order]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Shard:
    """Posting lists of some documents, which stand in ascending order of doc_id, with blocks and their greatest impacts."""

    def __init__(self, sizes: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.docs = len(sizes)
        doc = np.repeat(np.arange(self.docs), sizes)
        order = np.lexsort((doc, term))
        self.doc, self.impact = doc[order], impact[order]
        lists = np.searchsorted(term[order], np.arange(n_terms + 1))
        held = np.flatnonzero(np.diff(lists))
        self.first, self.last = block_ends(np.append(lists[held], lists[-1]), self.impact)
        self.top = np.maximum.reduceat(self.impact, self.first) if len(self.first) else self.impact
        self.from_doc, self.to_doc = self.doc[self.first], self.doc[self.last - 1]
        self.blocks = np.searchsorted(self.first, lists)
        self.opened = 0

    def _scores(self, blocks: np.ndarray, factor: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Scores of all documents, right for the live ones: blocks without a live document aren't opened."""
        before = np.concatenate([[0], np.cumsum(live)])
        use = before[self.to_doc[blocks] + 1] > before[self.from_doc[blocks]]
        blocks, factor = blocks[use], factor[use]
        size = self.last[blocks] - self.first[blocks]
        self.opened += len(blocks)
        at = _ranges(self.first[blocks], size)
        out = np.zeros(self.docs, np.int64)
        np.add.at(out, self.doc[at], self.impact[at] * np.repeat(factor, size))
        return out

    def search(self, query: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best with a score of `least` and more, equal scores by place. query: (term, factor).

        The pivot test is made for all documents at once: one can only score as much as the greatest impacts of the blocks over it,
        a function that steps at block boundaries. The documents with the highest bounds are scored first and raise the
        threshold; then those that can still reach it."""
        parts = [(np.arange(self.blocks[t], self.blocks[t + 1]), f) for t, f in query if self.blocks[t] < self.blocks[t + 1]]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks, factor = np.concatenate([b for b, _ in parts]), np.repeat([f for _, f in parts], [len(b) for b, _ in parts])
        step = np.zeros(self.docs + 1, np.int64)
        bound = factor * self.top[blocks]
        np.add.at(step, self.from_doc[blocks], bound)
        np.subtract.at(step, self.to_doc[blocks] + 1, bound)
        bound = np.cumsum(step)[:-1]
        live = bound >= least
        if live.sum() > 4 * k:
            seeds = np.zeros(self.docs, bool)
            seeds[np.argpartition(-bound, 2 * k)[: 2 * k]] = True
            sample = self._scores(blocks, factor, seeds)[seeds]
            least = max(least, int(np.partition(sample, -k)[-k]))
            live = bound >= least
        scores = self._scores(blocks, factor, live)
        found = np.flatnonzero(live & (scores >= least))
        found = found[np.argsort(-scores[found], kind="stable")[:k]]
        return found, scores[found]


def _in_shards(held: DataFrame, queries: list[list[tuple[int, int]]], n_terms: int, n_docs: int, total: int, k: int, shard_postings: int) -> DataFrame:
    """query, doc_id, score: each task's k best documents of each query. Its rows are taken in shards of bounded size, and what one
    shard has found is the threshold in the next."""
    kind = held.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]

        def search(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts).combine_chunks().sort_by("doc_id")  # nulls last
            ids, lists = table["doc_id"].to_pylist(), table["terms"].combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy().astype(np.int64))
            tf = table["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
            n = np.repeat(table["n"].to_numpy(), sizes)
            shard = Shard(sizes, lists.flatten().to_numpy(), impacts(tf, n, n_docs, total), n_terms)
            for q, query in enumerate(queries):
                least = max(1, best[q][-1][0]) if len(best[q]) == k else 1
                found, scores = shard.search(query, k, least)
                if len(found):
                    merged = best[q] + [(int(s), ids[d]) for d, s in zip(found, scores, strict=True)]
                    best[q] = sorted(merged, key=lambda x: (-x[0], x[1] is None, x[1]))[:k]

        parts, count = [], 0
        for b in batches:
            id_type, start = b["doc_id"].type, 0
            ends = b["terms"].offsets.to_numpy()
            while start < b.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + shard_postings - count, side="right")) - 1)
                stop = min(stop, b.num_rows)
                parts.append(b.slice(start, stop - start))
                count += int(ends[stop] - ends[start])
                start = stop
                if count >= shard_postings or start < b.num_rows:
                    search(parts)
                    parts, count = [], 0
        if parts:
            search(parts)
        rows = [(q, d, s) for q, found in enumerate(best) for s, d in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), id_type, pa.int64()), strict=True)], ["query", "doc_id", "score"])

    return held.select("doc_id", "n", "terms", "tfs").mapInArrow(work, f"query int, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, shard_postings: int = SHARD_POSTINGS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item (all with a score above 0, if fewer).

    Texts are read once a block of the stated query set, for postings of the terms that the block uses; the counts N, L and df are
    those of all documents. Shards are what tasks read of the postings, in pieces of bounded size, so postings aren't moved; the k
    best of each task are. Rows with one item_id are one query with the terms of all; a null item_id is a value as any other.
    Items and documents without terms have no rows; each row of docs is a document of its own, and equal scores go by
    ascending doc_id, null last."""
    spark = docs.sparkSession
    blocks = max(1, -(-items.count() // query_block))
    out = None
    for block in range(blocks):
        part = items.select("item_id", "text") if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).select("item_id", "text")
        queries: dict = {}
        for row in part.toLocalIterator():
            queries.setdefault(row.item_id, Counter()).update(t for t in terms(row.text) if t)
        wanted = {t: k for k, t in enumerate(sorted({t for q in queries.values() for t in q}))}
        held = written(postings(docs, wanted), "postings")
        n_docs, total = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r.term: r["count"] for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # a row for each term of the block at most
        factors = [[(wanted[t], times * weight(n_docs, df[wanted[t]])) for t, times in q.items() if wanted[t] in df] for q in queries.values()]
        found = _in_shards(held, [[(t, f) for t, f in q if f] for q in factors], len(wanted), n_docs, total, k, shard_postings)
        names = spark.createDataFrame(list(enumerate(queries)), f"query int, item_id {items.schema['item_id'].dataType.simpleString()}")
        best = Window.partitionBy("query", "_part").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        some = found.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        last = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        rows = some.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def oracle(k: int = 10) -> str:
    """DuckDB SQL that scores every document with every item."""
    return rf"""
    WITH words AS (
      SELECT 0 AS kind, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
      UNION ALL SELECT 1, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM benchmark),
    tf AS (SELECT id AS doc_id, term, count(*) AS tf FROM words WHERE kind = 0 GROUP BY ALL),
    size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
    whole AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM size),
    w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, nn),
    p AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nn) // ll)))) AS part FROM tf JOIN size USING (doc_id) JOIN w USING (term), whole),
    s AS (SELECT id AS item_id, doc_id, sum(part)::BIGINT AS score FROM words JOIN p USING (term) WHERE kind = 1 GROUP BY ALL HAVING sum(part) > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {k}"""
