"""Archives that were written without this library's writer: members, splits, filters and digests."""

import base64
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from turnwise.llm import warc


def record(kind, uri, payload, digest=None, http=True, name="WARC-Type"):
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" if http else b"") + payload
    head = f"WARC/1.0\r\n{name}: {kind}\r\nWARC-Record-ID: <urn:uuid:{uri}>\r\nWARC-Target-URI: {uri}\r\nX-Long: a\r\n b\r\n" + (f"WARC-Payload-Digest: {digest}\r\n" if digest else "") + f"Content-Type: {'application/http; msgtype=response' if http else 'text/plain'}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def archive(n=400, seed=1):
    rng, out = random.Random(seed), []
    for i in range(n):
        payload = rng.choice([b"", rng.randbytes(rng.randrange(9000)), b"text " * rng.randrange(3000), b"\r\n\r\n\r\n" + bytes([31, 139, 8]) + b"\r\n\r\nWARC/ no", gzip.compress(b"nested " * 50)])
        kind = rng.choice(["response", "response", "request", "metadata"])
        digest = rng.choice([None, "sha256:" + hashlib.sha256(payload).hexdigest(), "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()])
        out.append((kind, f"http://h{i % 7}.example/{i}", payload, digest, kind != "metadata", rng.choice(["WARC-Type", "warc-type"])))
    return out


def written(path, name, records, how):
    data = [record(*r) for r in records]
    body = b"".join(gzip.compress(d) for d in data) if how == "members" else gzip.compress(b"".join(data)) if how == "whole" else b"".join(gzip.compress(b"".join(data[k : k + 3])) for k in range(0, len(data), 3)) if how == "threes" else b"".join(data)
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "wb") as f:
        f.write(body)


@pytest.mark.parametrize("part", [32 << 20, 50_000, 700])
@pytest.mark.parametrize(("how", "name"), [("members", "a.warc.gz"), ("whole", "a.warc.gz"), ("threes", "a.warc.gz"), ("plain", "a.warc")])
def test_foreign_archives(spark, tmp_path, monkeypatch, part, how, name):
    records = archive(120)
    written(str(tmp_path), name, records, how)
    monkeypatch.setattr(warc, "PART_BYTES", part)
    reader = warc._Reader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) > 1 or part > 1 << 20
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["record_type"], r["target_uri"], r["payload"]) for r in got] == [(k, u, p) for k, u, p, *_ in records]
    assert all(r["payload_bytes"] == len(r["payload"]) and r["payload_digest"] == hashlib.sha256(r["payload"]).hexdigest() and r["page_id"] is None for r in got)


@pytest.mark.parametrize(("how", "name"), [("members", "a.warc.gz"), ("whole", "a.warc.gz"), ("threes", "a.warc.gz"), ("plain", "a.warc")])
def test_filters_skip_payloads(spark, tmp_path, monkeypatch, how, name):
    records = archive(90, 2)
    written(str(tmp_path / "in" / "deep"), name, records, how)
    taken = []
    whole = warc._Reader._payload
    monkeypatch.setattr(warc._Reader, "_payload", lambda self, head, block, row, file: taken.append(row["target_uri"]) or whole(self, head, block, row, file))
    reader = warc._Reader({"path": str(tmp_path / "in")})
    reader.tests = {"record_type": {"request"}}
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    want = [(u, p) for k, u, p, *_ in records if k == "request"]
    assert [(r["target_uri"], r["payload"]) for r in got] == want and taken == [u for u, _ in want]
    df = warc.read_warc(spark, str(tmp_path / "in"), payload="skip").where((F.col("record_type") == "metadata") & F.col("target_uri").isin("http://h1.example/1", *(u for _, u, *_ in records[:20])))
    assert sorted(r.target_uri for r in df.collect()) == sorted(u for k, u, *_ in records[:20] if k == "metadata") and all(r.payload is None for r in df.collect())


def test_one_file_and_odd_files(spark, tmp_path):
    written(str(tmp_path), "one.warc.gz", [("response", "http://a/", b"x", None, True, "WARC-Type")], "members")
    assert [r.payload for r in warc.read_warc(spark, str(tmp_path / "one.warc.gz")).collect()] == [bytearray(b"x")]
    written(str(tmp_path / "more"), "empty.warc.gz", [], "plain")
    written(str(tmp_path / "more"), "notes.txt", archive(3), "plain")
    assert warc.read_warc(spark, str(tmp_path / "more")).count() == 0
    written(str(tmp_path / "bad"), "b.warc", [("response", "http://a/", b"x", "sha1:" + "A" * 32, True, "WARC-Type")], "plain")
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark, str(tmp_path / "bad")).collect()


def test_own_archives_are_standard(spark, tmp_path):
    """Read with and without the manifest, and by gzip alone. Extra and clashing columns of pages are passed over."""
    rows = [(i, f"http://a/{i}", "<p>" + "x" * 300 if i % 3 else f"<p>{i}", "clash", 7) for i in range(50)] + [(None, None, None, "c", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, record_type int")
    path = str(tmp_path / "own")
    warc.write_warc(pages, path)
    listed = sorted(map(repr, warc.read_warc(spark, path).collect()))
    os.remove(f"{path}/{warc.MANIFEST}")
    assert sorted(map(repr, warc.read_warc(spark, path).collect())) == listed and len(listed) == 51
    data = b"".join(gzip.decompress(open(f"{path}/{f}", "rb").read()) for f in os.listdir(path) if f.endswith(".warc.gz"))
    assert data.count(b"WARC/1.1\r\n") == 51
