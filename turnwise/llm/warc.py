"""WARC archives as a PySpark data source: planned file parts, pushed filters, headers before payloads."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from turnwise.llm.common import scratch_path

#: Payloads under this many bytes are always stored.
LEAST_REVISIT = 100
#: Compressed bytes of a file that one read task takes.
PART_BYTES = 32 << 20
MANIFEST = "_records.json"
SCHEMA = "record_type string, record_id string, page_id long, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_DATE = "2020-01-01T00:00:00Z"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _member(record: bytes) -> bytes:
    """A gzip member whose extra field tells its own length ("sl": compressed and plain), so that a reader can step over it."""
    pack = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = pack.compress(record) + pack.flush()
    total = 12 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(record))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _record(kind: str, page: int | None, url: str | None, refers: int | None, size: int, digest: str, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>", "WARC-Date": _DATE}
    if page is not None:
        head["X-Page-Id"] = page
    if url is not None:
        head["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    head |= {"WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Bytes": size, "Content-Type": "application/http; msgtype=response"}
    if kind == "revisit":
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers}')}>"
        head["X-Refers-To-Page"] = refers
    block = http + (payload if kind == "response" else b"")
    head["Content-Length"] = len(block)
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    file: str
    starts: list
    size: int
    records: int


class _Writer(DataSourceArrowWriter):
    """A file for each task, under a name of its own; only files that the committed manifest lists are ever read, so that what a
    lost or repeated task leaves behind is ignored."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        name, starts, at, n = f"part-{uuid.uuid4().hex}.warc.gz", [0], 0, 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                columns = [batch.column(k) for k in ("record_type", "page_id", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload")]
                for i in range(batch.num_rows):
                    kind, page, url, refers, size, digest, payload = (c[i].as_py() for c in columns)
                    data = _member(_record(kind, page, url, refers, size, digest, payload or b""))
                    if at - starts[-1] >= PART_BYTES:
                        starts.append(at)
                    out.write(data)
                    at, n = at + len(data), n + 1
        return _Written(name, starts, at, n)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        listed = [{"file": m.file, "starts": m.starts, "size": m.size, "records": m.records} for m in messages if m and m.records]
        with fs.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        fs, root = _open(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{root}/{m.file}")


@dataclass
class _Part(InputPartition):
    file: str
    start: int
    end: int
    listed: bool = True


_HEAD = re.compile(rb"WARC/[0-9]+\.[0-9]+\r?\n")
_AFTER = re.compile(rb"\r?\n\r?\n(?=WARC/[0-9]+\.[0-9]+\r?\n)")
_GZIP = b"\x1f\x8b\x08"


class _Bytes:
    """Bytes of an archive from a place on: as they stand, or inflated to the end of a gzip member."""

    def __init__(self, f, at: int, gzip: bool):
        self.f, self.at, self.inflate, self.held, self.over = f, at, zlib.decompressobj(31) if gzip else None, b"", False

    def fill(self, n: int) -> bool:
        """Whether n bytes are at hand, after reading on."""
        while len(self.held) < n and not self.over:
            self.f.seek(self.at)
            chunk = self.f.read(1 << 16)
            self.at += len(chunk)
            self.over = not chunk
            if self.inflate:
                data = self.inflate.decompress(chunk)
                if self.inflate.eof:
                    self.over, self.at = True, self.at - len(self.inflate.unused_data)
                self.held += data
            else:
                self.held += chunk
        return len(self.held) >= n

    def take(self, n: int) -> bytes:
        self.fill(n)
        out, self.held = self.held[:n], self.held[n:]
        return out

    def skip(self, n: int) -> None:
        if not self.inflate and n > len(self.held):
            self.at, self.held = self.at + n - len(self.held), b""
        while n and (self.held or self.fill(1)):
            step = min(n, len(self.held))
            self.held, n = self.held[step:], n - step

    def head(self) -> tuple[dict[str, str], int] | None:
        """The header of the next record, names in lower case, and its bytes; None at the end."""
        while self.fill(1) and self.held[:1] in b"\r\n":
            self.held = self.held[1:]
        n = 4096
        while True:
            self.fill(n)
            m = re.search(rb"\r?\n\r?\n", self.held)
            if m or self.over or n > 1 << 24:
                break
            n *= 4
        if m is None or not _HEAD.match(self.held):
            if self.held.strip():
                raise ValueError("no WARC record where one should start")
            return None
        lines = re.sub(r"\r?\n[ \t]+", " ", self.take(m.end()).decode("utf-8", "replace")).splitlines()[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}, m.end()


def _next_member(f, at: int, size: int) -> int:
    """The first place from `at` on where a gzip member starts that holds a record, or the file's end."""
    while at < size:
        f.seek(at)
        chunk = f.read(1 << 20)
        hit = chunk.find(_GZIP)
        while hit >= 0:
            f.seek(at + hit)
            try:
                if zlib.decompressobj(31).decompress(f.read(4096), 5).startswith(b"WARC/"):
                    return at + hit
            except zlib.error:
                pass
            hit = chunk.find(_GZIP, hit + 1)
        at += max(1, len(chunk) - 2) if at + len(chunk) < size else len(chunk) or size
    return size


def _next_record(f, at: int, size: int) -> int:
    """The first place from `at` on where a record of an uncompressed archive starts behind another one's end, or the file's end. What
    looks like one must have a type and a length that leads to the next record or to the end. (An archive that holds others
    uncompressed, as payloads, can still mislead a part that starts inside of one; it is to be read as one part.)"""
    start = max(0, at - 64)
    while start < size:
        f.seek(start)
        chunk = f.read((1 << 20) + 64)
        for m in _AFTER.finditer(chunk):
            place = start + m.end()
            if place >= at and _leads_on(f, place):
                return place
        start += 1 << 20
    return size


def _leads_on(f, place: int) -> bool:
    data = _Bytes(f, place, False)
    try:
        head, _ = data.head()
    except ValueError:
        return False
    if "warc-type" not in head or not head.get("content-length", "").isdigit():
        return False
    data.skip(int(head["content-length"]))
    after = data.take(32)
    return not after.strip() or bool(re.match(rb"\r?\n\r?\nWARC/", after))


class _Reader(DataSourceReader):
    """Options: path; payload full (decoded, checked and returned), verify (decoded and checked only) or skip (never decoded).

    path: a folder that this module wrote, a folder with .warc and .warc.gz files below it, or such a file. Files are planned in
    parts of PART_BYTES; a part has the records that start in it. Of archives by others, page_id and refers_to are null, payload_digest
    is computed where no SHA-256 is told, and payload_bytes and payload_digest may be null where the payload is skipped.

    Filters on record_type, page_id and target_uri are tested on the headers; the payload of a record that fails isn't inflated."""

    FIELDS = ("record_type", "page_id", "target_uri")

    def __init__(self, options):
        self.path, self.payload, self.tests = options["path"], options.get("payload", "full"), {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in self.FIELDS and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tests[name] = self.tests.get(name, wanted) & wanted
            else:
                yield f

    def partitions(self):
        fs, root = _open(self.path)
        found = fs.get_file_info(root)
        if found.is_file:
            files = [(root, found.size)]
        elif fs.get_file_info(f"{root}/{MANIFEST}").is_file:
            with fs.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
                listed = json.loads(f.read())
            return [_Part(f"{root}/{x['file']}", a, b) for x in listed for a, b in zip(x["starts"], [*x["starts"][1:], x["size"]], strict=True)] or [_Part("", 0, 0)]
        else:
            files = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith((".warc", ".warc.gz")))
        return [_Part(path, a, min(size, a + PART_BYTES), False) for path, size in files for a in range(0, size, PART_BYTES)] or [_Part("", 0, 0)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        rows, held = [], 0
        for row in self._records(part) if part.listed else self._found(part):
            rows.append(row)
            held += len(row["payload"] or b"") + 200
            if held > 4 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    def _records(self, part: _Part) -> Iterator[dict]:
        if not part.file:
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(part.file) as f:
            at = part.start
            while at < part.end:
                f.seek(at)
                start = f.read(4096)
                total = struct.unpack("<I", start[16:20])[0]
                inflate = zlib.decompressobj(-15)
                body = start[24 : total - 8]
                text = inflate.decompress(body, 2048)
                while b"\r\n\r\n" not in text and inflate.unconsumed_tail:
                    text += inflate.decompress(inflate.unconsumed_tail, 2048)
                end = text.find(b"\r\n\r\n")
                if end < 0:  # headers longer than what was read: take the whole member
                    f.seek(at + 24)
                    inflate = zlib.decompressobj(-15)
                    text, body, start = inflate.decompress(f.read(total - 32)), b"", b"\0" * total
                    end = text.index(b"\r\n\r\n")
                head = dict(x.split(": ", 1) for x in text[:end].decode().split("\r\n")[1:])
                row = {
                    "record_type": head["WARC-Type"], "record_id": head["WARC-Record-ID"], "page_id": int(head["X-Page-Id"]) if "X-Page-Id" in head else None,
                    "target_uri": head.get("WARC-Target-URI"), "refers_to": int(head["X-Refers-To-Page"]) if "X-Refers-To-Page" in head else None,
                    "payload_bytes": int(head["X-Payload-Bytes"]), "payload_digest": head["WARC-Payload-Digest"].partition(":")[2], "payload": None,
                }
                if all(row[k] in wanted for k, wanted in self.tests.items()):
                    if self.payload != "skip" and row["record_type"] == "response":
                        rest = inflate.decompress(inflate.unconsumed_tail)
                        if total - 8 > len(start):
                            rest += inflate.decompress(f.read(total - 8 - len(start)))
                        block = (text + rest)[end + 4 : end + 4 + int(head["Content-Length"])]
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if len(payload) != row["payload_bytes"] or hashlib.sha256(payload).hexdigest() != row["payload_digest"]:
                            raise ValueError(f"{part.file} at {at}: the payload isn't that of its digest")
                        row["payload"] = payload if self.payload == "full" else None
                    yield row
                at += total


    def _found(self, part: _Part) -> Iterator[dict]:
        """The records that start in a part of any archive: gzip members are found by their first bytes and what they hold, records of
        uncompressed files by the end of the one before. What filters leave out isn't inflated if the next member's start and
        the length that this one tells of itself agree that it holds nothing else."""
        fs, _ = _open(self.path)
        gzip = part.file.endswith(".gz")
        with fs.open_input_file(part.file) as f:
            size = f.size()
            at = _next_member(f, part.start, size) if gzip else part.start if part.start == 0 else _next_record(f, part.start, size)
            while at < part.end:
                start, data = at, _Bytes(f, at, gzip)
                while (found := data.head()) is not None:
                    head, length = found
                    row, body = self._row(head), int(head.get("content-length", 0))
                    good = all(row[k] in wanted for k, wanted in self.tests.items())
                    if good and self.payload != "skip":
                        yield row | self._payload(head, data.take(body), row, part.file)
                        body = 0
                    elif good:
                        yield row
                    if not body:
                        pass
                    elif gzip:
                        following = _next_member(f, start + 1, size)
                        f.seek(following - 4)
                        if f.read(4) == struct.pack("<I", (length + body + 4) & 0xFFFFFFFF):
                            data.at = following
                            break
                        data.skip(body)
                    else:
                        data.skip(body)
                    if not gzip:
                        while data.fill(1) and data.held[:1] in b"\r\n":
                            data.held = data.held[1:]
                        break
                at = data.at if gzip else data.at - len(data.held)
                if not gzip and not data.fill(1):
                    return

    @staticmethod
    def _row(head: dict[str, str]) -> dict:
        digest = head.get("warc-payload-digest", "")
        number = lambda k: int(head[k]) if head.get(k, "").isdigit() else None
        return {
            "record_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "page_id": number("x-page-id"), "target_uri": head.get("warc-target-uri", "").strip("<>") or None, "refers_to": number("x-refers-to-page"),
            "payload_bytes": number("x-payload-bytes"), "payload_digest": digest[7:] if digest.startswith("sha256:") else None, "payload": None,
        }

    def _payload(self, head: dict[str, str], block: bytes, row: dict, file: str) -> dict:
        """The payload of a block: what stands behind the HTTP header, or all of it. Digests by SHA-256 and SHA-1 are checked."""
        http = head.get("content-type", "").startswith("application/http")
        m = re.search(rb"\r?\n\r?\n", block) if http else None
        payload = block[m.end() :] if m else b"" if http else block
        if row["record_type"] == "revisit":
            return {}
        kind, _, told = head.get("warc-payload-digest", "").partition(":")
        own = {"sha256": lambda: hashlib.sha256(payload).hexdigest(), "sha1": lambda: base64.b32encode(hashlib.sha1(payload).digest()).decode()}.get(kind.lower())
        if own and told.lower() not in (own().lower(), hashlib.sha1(payload).hexdigest()):
            raise ValueError(f"{file}: the payload of {row['record_id']} isn't that of its digest")
        return {"payload_bytes": len(payload), "payload_digest": row["payload_digest"] or hashlib.sha256(payload).hexdigest(), "payload": payload if self.payload == "full" else None}


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: str = "full") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


def with_roles(pages: DataFrame) -> DataFrame:
    """The records of pages: of those with equal payloads of 100 bytes or more the least page_id is the response and the others
    revisit it; smaller ones are all responses.

    Null html: an empty payload. Rows that repeat the response's page_id are responses too; a null page_id revisits, or is a
    response if its group has no other. Only digests that occur twice are joined, so the join is narrow on that side and
    Spark can split a digest that many pages share."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    held = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload")).select(
        "*", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    long = held.where(F.col("payload_bytes") >= LEAST_REVISIT)
    first = long.groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    revisit = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id")) & (F.col("payload_bytes") >= LEAST_REVISIT)
    joined = held.join(first, "payload_digest", "left").withColumn("_revisit", revisit)
    return joined.select(
        F.when(F.col("_revisit"), F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.lit(None).cast("string").alias("record_id"), "page_id", "target_uri",
        F.when(F.col("_revisit"), F.col("_first")).alias("refers_to"), "payload_bytes", "payload_digest", F.when(~F.col("_revisit"), F.col("payload")).alias("payload"),
    )


def write_warc(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    with_roles(pages).write.format("warc").mode("append").save(path)


def archived(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder, read them back with every payload decoded and checked, and return page_id,
    payload_bytes, payload_digest, record_type and refers_to of every record."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path, payload="verify").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f"""
