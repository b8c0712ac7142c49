"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.arrowtext import pieces

#: Hashed byte trigrams; bucket 0 is kept for places that count for nothing.
BUCKETS = 1 << 15
#: Texts of each language that a model is fitted on, as expected by a hash of their ids. Fewer are all taken.
FIT_TEXTS = 3000
#: Documents whose crc32 of the id as text leaves this remainder modulo 4 are never learnt from.
HELD_OUT = 2

# Letters lower-cased, bytes of longer characters as they are, everything else a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def held_out(key="doc_id"):
    """Null ids count as the word null."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")), F.lit(4)) == HELD_OUT


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bucket of the trigram at every byte; 0 at blanks and where a trigram would cross into the next text."""
    x = _FOLD[data]
    if len(x) < 3:
        return np.zeros(len(x), np.int32)
    capital = (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E)
    x[1:][capital] += 0x20
    y = x.astype(np.uint32)
    code = (y[:-2] << np.uint32(16)) | (y[1:-1] << np.uint32(8)) | y[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(17)
    out = np.zeros(len(x), np.int32)
    out[:-2] = np.maximum(code, 1)
    blank = x == 32
    out[:-1][blank[:-1] & blank[1:]] = 0
    out[:-2][blank[1:-1] & blank[2:]] = 0
    for back in (1, 2):
        cut = offsets[1:] - back
        out[cut[cut >= 0]] = 0
    return out


def codewords(languages: int, least_bits: int = 15, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each language. Up to six languages get all distinct splits; more get the best of many random codes,
    by least distance between rows."""
    if languages <= 1:
        return np.ones((languages, 1), np.int8)
    if languages <= 6:
        splits = np.arange(1, 1 << (languages - 1))
        return np.array([np.where((splits >> (languages - 1 - i)) & 1, 1, -1) if i else -np.ones(len(splits)) for i in range(languages)], np.int8)
    bits, rng, best, far = max(least_bits, 10 * int(np.ceil(np.log2(languages)))), np.random.default_rng(seed), None, (-1, -1)
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        gaps = (bits - code.astype(int) @ code.T.astype(int)) // 2 + bits * np.eye(languages, dtype=int)
        if (found := (gaps.min(), int((np.abs(code.sum(0)) < languages).all()))) > far:
            best, far = code, found
    return best


class Model:
    """Weights of one linear classifier a bit, the codewords, and how far each bit is to be trusted for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        share = (counts + 0.2) / (counts + 0.2).sum(1, keepdims=True) if len(languages) else np.zeros((0, BUCKETS))
        rows = []
        for bit in self.code.T if len(languages) > 1 else []:
            # A trigram's weight: the log odds of its mean share among the languages of either side.
            rows.append(np.log(share[bit > 0].mean(0)) - np.log(share[bit < 0].mean(0)))
        self.weights = np.array(rows or [np.zeros(BUCKETS)], np.float32).T.copy()
        self.weights[0] = 0
        self.trust = np.ones(self.code.shape)

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean weight a bit, and the number of trigrams, for every text."""
        at = trigrams(data, offsets)
        n = len(offsets) - 1
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        sums, count = np.zeros((n, self.weights.shape[1])), np.zeros(n)
        if len(full):
            sums[full] = np.add.reduceat(self.weights[at], offsets[:-1][full], axis=0, dtype=np.float64)
            count[full] = np.add.reduceat((at > 0).astype(np.float64), offsets[:-1][full])
        return sums / np.maximum(count, 1)[:, None], count

    def decode(self, margins: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codeword of least weighted loss, a score in 0 to 1, and whether the next one is about as near."""
        # Longer texts make surer bits, up to a bound.
        z = np.clip(margins * np.minimum(np.sqrt(count), 40.0)[:, None], -30, 30)
        loss = np.stack([(np.log1p(np.exp(-c * z)) * t).sum(1) / t.sum() for c, t in zip(self.code.astype(float), self.trust, strict=True)], 1)
        best = loss.argmin(1)
        odds = np.exp(-(loss - loss.min(1, keepdims=True)) * self.code.shape[1])
        score = odds.max(1) / odds.sum(1)
        return best, score, score < 0.75


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())


def fit(docs: DataFrame, texts: int = FIT_TEXTS) -> Model:
    """Learn from about `texts` labelled documents of each language, taken by a hash of their ids; whole texts.

    What reaches the driver is one count for each language and bucket, and one error rate for each language and bit."""
    known = _labelled(docs)
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    part = F.create_map(*(F.lit(v) for k in languages for v in (k, min(1.0, texts / totals[k]))))
    drawn = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1 << 20)) < F.element_at(part, F.col("lang")) * float(1 << 20)).select("lang", "text")
    index = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(index), BUCKETS), np.int64)
        for batch in batches:
            own = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            for start, end, data, offsets in pieces(batch.column(1)):
                at = trigrams(data, offsets)
                row = np.repeat(own[start:end], np.diff(offsets))
                found += np.bincount(row * BUCKETS + at, minlength=found.size).reshape(found.shape)
        row, bucket = np.nonzero(found)
        yield pa.RecordBatch.from_pydict({"l": pa.array(row, pa.int32()), "b": pa.array(bucket, pa.int32()), "n": pa.array(found[row, bucket], pa.int64())})

    summed = drawn.mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), BUCKETS))
    counts[summed["l"].to_numpy(), summed["b"].to_numpy()] = summed["n"].to_numpy()
    counts[:, 0] = 0
    model = Model(languages, counts)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, seen = np.zeros(model.code.shape, np.int64), np.zeros(len(index), np.int64)
        for batch in batches:
            own = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            for start, end, data, offsets in pieces(batch.column(1)):
                margins, _ = model.margins(data, offsets)
                np.add.at(bad, own[start:end], (margins * model.code[own[start:end]] <= 0).astype(np.int64))
                np.add.at(seen, own[start:end], 1)
        row, bit = np.indices(bad.shape).reshape(2, -1)
        yield pa.RecordBatch.from_pydict({"l": pa.array(row, pa.int32()), "b": pa.array(bit, pa.int32()), "bad": pa.array(bad.ravel()), "n": pa.array(seen[row])})

    rates = drawn.mapInArrow(errors, "l int, b int, bad long, n long").groupBy("l", "b").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).toPandas()
    wrong = (rates["bad"].to_numpy() + 1) / (rates["n"].to_numpy() + 4)
    model.trust[rates["l"].to_numpy(), rates["b"].to_numpy()] = np.clip(np.log((1 - wrong) / wrong), 0.1, 6)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row, from the text alone.

    Null texts and texts without a letter are und, score 0 and ambiguous; so are all if nothing was learnt. Repeated rows are
    predicted alike. Texts pass through Arrow in pieces of 1 MB; a longer text is one piece."""
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = pa.array([*own.languages, "und"])
        for batch in batches:
            n = batch.num_rows
            best, score, vague = np.full(n, len(own.languages)), np.zeros(n), np.ones(n, bool)
            if own.languages:
                letters = batch.column(3).to_numpy(zero_copy_only=False)
                for start, end, data, offsets in pieces(batch.column(2)):
                    best[start:end], score[start:end], vague[start:end] = own.decode(*own.margins(data, offsets))
                best[~letters], score[~letters], vague[~letters] = len(own.languages), 0, True
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names.take(pa.array(best)), pa.array(score), pa.array(vague)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, texts: int = FIT_TEXTS) -> DataFrame:
    """Fit on about `texts` labelled texts a language that aren't held out, then predict every row of docs (as predict does).

    Rows without a label aren't learnt from; other columns, lang and source among them, play no part in a prediction. Empty docs
    give no rows."""
    return predict(docs, fit(docs, texts))
