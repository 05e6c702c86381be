"""Archives and records that other programs write."""

from __future__ import annotations

import hashlib
import struct

import pytest
import zstandard

from corvane.llm import warc


def made(kind: str, block: bytes, version: bytes = b"WARC/1.0", **more: str) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "2020-01-01T00:00:00Z"} | {k.replace("_", "-"): v for k, v in more.items()} | {"Content-Length": str(len(block))}
    return version + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items()) + b"\r\n" + block + b"\r\n\r\n"


HTTP = {"Content_Type": "application/http; msgtype=response"}
BODY = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nhello"
RECORDS = [
    made("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
    made("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", Content_Type="application/http; msgtype=request"),
    made("response", BODY, **HTTP),  # neither a length of the body nor digests
    made("response", b"HTTP/1.0 200 OK\r\ncontent-length: 5 \r\n\r\nhello", b"WARC/1.1", WARC_Payload_Digest="sha1:" + hashlib.sha1(b"hello").hexdigest(), **HTTP),
    made("response", BODY, WARC_Block_Digest="blake3:abc", WARC_Payload_Digest="md5:" + hashlib.md5(b"hello").hexdigest(), **HTTP),
    made("metadata", b"k: v", Content_Type="application/warc-fields\r\n  ; charset=utf-8"),
    made("resource", b"\0\1", Content_Type="application/octet-stream"),
    made("revisit", b"", WARC_Profile="http://netpreserve.org/warc/1.0/revisit/server-not-modified"),
]


def test_records_of_other_writers():
    told = [warc.read_record(r) for r in RECORDS]
    assert [t["warc-type"] for t in told] == "warcinfo request response response response metadata resource revisit".split()
    assert [t["payload"] for t in told] == [b"software: x\r\n", b"", b"hello", b"hello", b"hello", b"k: v", b"\0\1", None]
    assert told[5]["content-type"] == "application/warc-fields ; charset=utf-8"
    bad = made("response", BODY, WARC_Payload_Digest="sha1:" + hashlib.sha1(b"other").hexdigest(), **HTTP)
    for r in (bad, made("response", b"no head", **HTTP), b"WARC/2.0" + RECORDS[0][8:], made("response", b"HTTP/1.0 200 OK\r\nContent-Length: 9\r\n\r\nhello", **HTTP)):
        with pytest.raises(warc.BadArchive):
            warc.read_record(r)


def test_files_of_other_writers(spark, tmp_path):
    packer = zstandard.ZstdCompressor()
    plain = b"".join(packer.compress(r) for r in RECORDS)
    noted = struct.pack("<II", 0x184D2A50, 3) + b"abc" + plain  # a skippable frame that holds no dictionary
    words = zstandard.train_dictionary(2000, [r * 3 for r in RECORDS] * 30)
    with_words = zstandard.ZstdCompressor(dict_data=words)
    packed = zstandard.ZstdCompressor().compress(words.as_bytes())
    third = struct.pack("<II", warc.DICT_MAGIC, len(packed)) + packed + b"".join(with_words.compress(r) for r in RECORDS)
    for k, x in enumerate((plain, noted, third)):
        assert list(warc.frames(x)) == RECORDS
        (tmp_path / f"{k}.warc.zst").write_bytes(x)
    (tmp_path / "readme.txt").write_text("no archive")
    out = warc.read_archives(warc.read_files(spark, str(tmp_path)), payloads=True).collect()
    assert len(out) == 3 * len(RECORDS) and sum(r.payload == b"hello" for r in out) == 9
    assert {r.payload_digest for r in out if r.payload == b"hello"} == {hashlib.sha1(b"hello").hexdigest()}


def test_record_ids_are_unique(spark):
    rows = [(1, "u", "x" * 2000), (1, "u", "x" * 2000), (2, "http://v/", "x" * 2000), (1, "u", "short"), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    told = [warc.read_record(f) for a in warc.write_archives(warc.plan_records(df)).collect() for f in warc.frames(bytes(a.archive))]
    assert len(told) == len({t["warc-record-id"] for t in told}) == len(rows)
    again = [t for t in told if t["warc-type"] == "revisit"]
    assert [t["warc-refers-to-target-uri"] for t in again] == ["http://v/"] * 2 and {t["x-refers-to-page-id"] for t in again} == {"2"}
