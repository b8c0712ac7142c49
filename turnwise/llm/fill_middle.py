"""Fill-in-the-middle transformation over a table of distinct texts with Elias-Fano lists of token ends."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seed of the cuts, percentage of documents that are cut, and of these the percentage in suffix-prefix-middle order.
SEED, CUT_PERCENT, SPM_PERCENT = 42, 50, 80
MARKS = ("<P>", "<S>", "<M>")
#: A text is hot if it holds more rows than this and more than one in HOT_SHARE of all rows; so there are HOT_SHARE hot ones at most.
HOT_ROWS, HOT_SHARE = 1000, 2000


def token_ends(text: str) -> np.ndarray:
    """Ends, in code points, of the tokens: a run of other characters with the blanks before it; blanks at the end are one token."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    ends = ~blank
    ends[:-1] &= blank[1:]
    if len(points):
        ends[-1] = True
    return np.flatnonzero(ends) + 1


def packed(values: np.ndarray) -> bytes:
    """Elias-Fano code of an ascending list of numbers from 0: the count, the width of the low parts, the low parts bit by bit, and
    the high parts as the distances between ones in a bit string. About 2 bits and the width for each number."""
    n = len(values)
    width = max(0, int(int(values[-1]) // n).bit_length() - 1) if n else 0
    head = np.array([n], "<u4").tobytes() + bytes([width])
    if not n:
        return head
    v = values.astype(np.uint64)
    low = (v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    high = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(high[-1]) + 1, np.uint8)
    bits[high] = 1
    return head + np.packbits(low.astype(np.uint8).ravel()).tobytes() + np.packbits(bits).tobytes()


def selected(code: bytes, at: list[int]) -> list[int]:
    """The numbers at these places of a packed list, without unpacking the others."""
    n, width = int(np.frombuffer(code, "<u4", 1)[0]), code[4]
    size = -(-n * width // 8)
    low, ones = np.frombuffer(code, np.uint8, size, 5), np.frombuffer(code, np.uint8, offset=5 + size)
    before = np.cumsum(np.bitwise_count(ones), dtype=np.int64)
    out = []
    for i in at:
        byte = int(np.searchsorted(before, i + 1))
        rank = i - (int(before[byte - 1]) if byte else 0)
        place = 8 * byte + int(np.flatnonzero(np.unpackbits(ones[byte : byte + 1]))[rank])
        first, last = i * width, (i + 1) * width
        bits = np.unpackbits(low[first // 8 : last // 8 + 1])[first % 8 : first % 8 + width]
        out.append(((place - i) << width) + sum(int(b) << k for k, b in enumerate(bits)))
    return out


def _key(text: Column) -> list[Column]:
    return [F.octet_length(text).alias("_size"), F.xxhash64(text).alias("_h1"), F.xxhash64(text, F.lit(1)).alias("_h2")]


def text_index(docs: DataFrame) -> DataFrame:
    """text, doc_ids, n, ends: a row for each distinct text with the documents that hold it, its number of tokens and the packed
    list of their ends. Null text counts as the empty text.

    Rows are grouped by the text itself, so that only texts with equal content share a row. A text travels once from each task that
    reads it. A hot text (see HOT_ROWS, HOT_SHARE) is dealt in shares by doc_id, and has a row for each share."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    sizes = rows.select(*_key(F.col("text"))).groupBy("_size", "_h1", "_h2").agg(F.count("*").alias("_n"))
    most = max(HOT_ROWS, rows.count() // HOT_SHARE)
    hot = sizes.where(F.col("_n") > most).withColumn("_shares", F.ceil(F.col("_n") / most).cast("int")).drop("_n")
    keyed = rows.select("doc_id", "text", *_key(F.col("text"))).join(F.broadcast(hot), ["_size", "_h1", "_h2"], "left")
    share = F.coalesce(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("_shares")), F.lit(0))
    # Null ids are wrapped, as collect_list leaves plain nulls out.
    grouped = keyed.select("doc_id", "text", share.alias("_share")).groupBy("text", "_share").agg(F.collect_list(F.struct("doc_id")).alias("docs"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [token_ends(t.as_py()) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["text"], b["doc_ids"], pa.array([len(e) for e in ends], pa.int64()), pa.array([packed(e) for e in ends], pa.binary())], ["text", "doc_ids", "n", "ends"])

    return grouped.select("text", F.transform("docs", lambda d: d["doc_id"]).alias("doc_ids")).mapInArrow(index, f"text string, doc_ids array<{kind}>, n long, ends binary")


def _form(text: str, h: list[int]) -> str:
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= CUT_PERCENT:
        return "plain"
    return "spm" if h[3] % 100 < SPM_PERCENT else "psm"


def cut(index: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every document of a text_index().

    The cut is seeded by `seed` and doc_id (a null id counts as the empty string), and its two ends are selected from the packed
    list. Repeated doc_ids with one text give equal rows."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for text, ids, n, ends in zip(b["text"], b["doc_ids"], b["n"], b["ends"], strict=True):
                text, n, ends = text.as_py(), n.as_py(), ends.as_py()
                for doc_id in ids.as_py():
                    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
                    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
                    form = _form(text, h)
                    if form == "plain":
                        held.append((doc_id, n, form, None, None, text))
                    else:
                        places = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                        chosen = iter(selected(ends, [p - 1 for p in places if p]))
                        a, z = (next(chosen) if p else 0 for p in places)
                        p, m, s = text[:a], text[a:z], text[z:]
                        held.append((doc_id, n, form, a, z - a, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"))
                    size += len(text)
                    if size > 1 << 23:
                        yield _batch(held, schema)
                        held, size = [], 0
            if held:
                yield _batch(held, schema)

    schema = pa.schema([("doc_id", b_type(kind)), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
    return index.mapInArrow(rows, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def b_type(kind: str) -> pa.DataType:
    """Arrow's type of a doc_id column."""
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (code points, null if plain) and output of every row of docs."""
    return cut(text_index(docs), seed)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Texts that hold a mark are plain, so the marks of other forms are where they were put."""
    part = lambda k: F.element_at(F.split(output, "<P>|<S>|<M>", -1), k)
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """fill_in_middle()'s rows with checksums in the place of texts."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def oracle() -> str:
    """DuckDB SQL with token lists in the place of packed ends."""
    return r"""
    WITH t AS (
      SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
    h AS (
      SELECT doc_id, text, u, len(u) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM t),
    f AS (
      SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
    c AS (
      SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c"""
