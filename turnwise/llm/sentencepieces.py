"""SentencePiece encoding and decoding over a table of distinct chunks.

If no piece crosses the start of a run of white-space markers, a text may be segmented in chunks: a run of markers and what follows up
to the next. Each distinct chunk is segmented once, and the ids are put back by position."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import scratch_path

MARKER = "▁"
_CHUNK = re.compile(" *[^ ]+| +")
#: UTF-8 bytes of the documents in a block (a longer document is a block), and of the chunks in a bucket of the table.
BLOCK_BYTES, BUCKET_BYTES = 24 << 20, 4 << 20


def model_bytes(path: str) -> bytes:
    """A model's file, if its pieces and rules allow cutting before markers; else a ValueError says why not."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        data = f.read()
    model = sentencepiece_model_pb2.ModelProto.FromString(data)
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: only models that keep text as it is, with a marker before it, can be cut in chunks")
    if any(p.type == p.USER_DEFINED or re.search(f"[^{MARKER}]{MARKER}", p.piece) for p in model.pieces):
        raise ValueError(f"{path}: a piece crosses the start of a run of markers")
    return data


class _Codes(dict):
    """A number for each chunk, in order of appearance."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = code = len(self)
        return code


def chunks_of(text: str) -> list[str]:
    """The chunks of a text after normalisation, markers written as blanks. Each starts with one; the empty text has none."""
    return _CHUNK.findall(" " + text.replace(MARKER, " ")) if text else []


def _small(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def _large(data: bytes) -> bytes:
    return zstandard.decompress(data)


_BLOCK = "block string, doc_ids array<{0}>, sizes array<int>, codes binary, chunks binary, chunk_bytes long"


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """A row for each block: the documents' ids, numbers of chunks and chunks' codes, and the distinct chunks, most frequent first."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, codes, size = [], [], _Codes(), 0

        def flush() -> pa.RecordBatch:
            places = np.concatenate(rows)
            order = np.argsort(-np.bincount(places, minlength=len(codes)), kind="stable")
            rank = np.empty(len(order), "<i4")
            rank[order] = np.arange(len(order), dtype="<i4")
            names = list(codes)
            data = MARKER.join(names[k] for k in order).encode()
            values = [[uuid.uuid4().hex], [ids], [[len(r) for r in rows]], [rank[places].tobytes()], [_small(data)], [len(data)]]
            return pa.RecordBatch.from_arrays([pa.array(values[0]), pa.array(values[1], pa.list_(id_type)), pa.array(values[2], pa.list_(pa.int32())), *(pa.array(v, pa.binary()) for v in values[3:5]), pa.array(values[5], pa.int64())], ["block", "doc_ids", "sizes", "codes", "chunks", "chunk_bytes"])

        for b in batches:
            id_type = b["doc_id"].type
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                own = text.as_buffer().size if text.is_valid else 0
                if ids and size + own > block_bytes:
                    yield flush()
                    ids, rows, codes, size = [], [], _Codes(), 0
                found = chunks_of(text.as_py() or "")
                ids.append(doc_id)
                rows.append(np.fromiter(map(codes.__getitem__, found), "<i4", len(found)))
                size += own + 16
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(work, _BLOCK.format(kind))


def _names(data: bytes) -> list[str]:
    text = _large(data).decode()
    return text.split(MARKER) if text else []


def _buckets(names: list[str], n: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(x.encode()) % n for x in names), np.int64, len(names))


def _parts(blocks: DataFrame, n: int) -> DataFrame:
    """bucket, block, chunks: each block's chunks of each bucket of the table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b["block"], b["chunks"], strict=True):
                names = _names(data.as_py())
                if not names:
                    continue
                bucket = _buckets(names, n)
                order = np.argsort(bucket, kind="stable")
                at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                parts = [order[i:j] for i, j in zip(at, [*at[1:], len(order)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[order[at]], pa.int32()), pa.array([block.as_py()] * len(parts)), pa.array([_small(MARKER.join(names[k] for k in p).encode()) for p in parts], pa.binary())], ["bucket", "block", "chunks"])

    return blocks.select("block", "chunks").mapInArrow(work, "bucket int, block string, chunks binary")


class Segmenter:
    """Chunks to ids and back with a model."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        one = self.model.encode("a")
        self.lone = self.model.encode("a ")[len(one) :]

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """The library puts a marker before each text, so a chunk goes without its first; a lone marker has the ids behind another chunk."""
        return [ids if len(c) > 1 else self.lone for c, ids in zip(chunks, self.model.encode([c[1:] for c in chunks], num_threads=1), strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The library takes away a text's first marker, which only the first chunk of a document is to lose."""
        return [" " + text for text in self.model.decode(ids)] if ids else []


_TABLE = "block string, bucket int, sizes binary, ids binary, odd array<int>, odd_text array<string>"


def _segmented(parts: DataFrame, model: bytes) -> DataFrame:
    """block, bucket, numbers of ids and ids of the chunks of each part, and the places and texts of chunks that aren't decoded to
    themselves. A bucket holds all blocks' copies of a chunk, and segments and decodes it once."""

    def work(table: pa.Table) -> pa.Table:
        lists = [_names(x.as_py()) for x in table["chunks"]]
        distinct = list(dict.fromkeys(c for names in lists for c in names))
        code = {c: k for k, c in enumerate(distinct)}
        segmenter = Segmenter(model)
        ids = segmenter.encode(distinct)
        odd = {c: back for c, back in zip(distinct, segmenter.decode(ids), strict=True) if back != c}
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for one in ids for i in one), "<i4", int(sizes.sum()))
        out = {k: [] for k in ("sizes", "ids", "odd", "odd_text")}
        for names in lists:
            at = np.fromiter(map(code.__getitem__, names), np.int64, len(names))
            out["sizes"].append(_small(sizes[at].astype("<i4").tobytes()))
            out["ids"].append(_small(flat[_ranges(np.cumsum(sizes)[at] - sizes[at], sizes[at])].tobytes()))
            found = [k for k, c in enumerate(names) if c in odd]
            out["odd"].append(found)
            out["odd_text"].append([odd[names[k]] for k in found])
        kinds = (pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string()))
        return pa.table([table["block"], table["bucket"], *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["block", "bucket", *out])

    return parts.groupBy("bucket").applyInArrow(work, _TABLE)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range behind another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def encode_decode(docs: DataFrame, model_path: str, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, ids, decoded of every row of docs: the ids that the library gives the whole text, without begin and end, and the
    text that it gives for these ids.

    Texts are read once. Tasks write blocks of documents as codes of the block's distinct chunks. These meet in a table of buckets
    by the chunk's hash, where each distinct chunk is segmented once, however many blocks hold it; a frequent chunk is one row a block.
    Blocks lie in Hive buckets by their id, so that codes aren't moved when the ids come back to them. Null and empty texts have no
    ids; repeated rows each get a row."""
    spark, model = docs.sparkSession, model_bytes(model_path)
    name, path = f"sentencepiece_blocks_{uuid.uuid4().hex}", scratch_path(docs.sparkSession, "sentencepiece-blocks")
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    _blocks(docs, block_bytes).write.bucketBy(n, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    blocks = spark.table(name)
    total = blocks.agg(F.sum("chunk_bytes")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    found = _segmented(_parts(blocks, buckets), model)
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[docs.schema["doc_id"].dataType.simpleString()]

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()[0]
        names = _names(rows["chunks"])
        decoded = np.empty(len(names), object)
        decoded[:] = names
        sizes, starts, flat = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), []
        if names:
            bucket = _buckets(names, buckets)
            order = np.argsort(bucket, kind="stable")
            first, base = np.searchsorted(bucket[order], np.arange(buckets)), 0
            for part in right.to_pylist():
                own = np.frombuffer(_large(part["sizes"]), "<i4").astype(np.int64)
                at = order[first[part["bucket"]] : first[part["bucket"]] + len(own)]
                sizes[at], starts[at] = own, base + np.cumsum(own) - own
                flat.append(np.frombuffer(_large(part["ids"]), "<i4"))
                base += len(flat[-1])
                for k, text in zip(part["odd"], part["odd_text"], strict=True):
                    decoded[at[k]] = text
        flat = np.concatenate(flat) if flat else np.zeros(0, "<i4")
        codes = np.frombuffer(rows["codes"], "<i4")
        edges = np.concatenate([[0], np.cumsum(rows["sizes"])]).astype(np.int64)
        ids = flat[_ranges(starts[codes], sizes[codes])]
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])[edges]
        texts = ["".join(decoded[codes[i:j]])[1:] for i, j in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table([pa.array(rows["doc_ids"], id_type), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return blocks.drop("chunk_bytes").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(assemble, f"doc_id {kind}, ids array<int>, decoded string")


def digests(made: DataFrame) -> DataFrame:
    """encode_decode()'s rows with checksums in the place of ids and texts."""
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
