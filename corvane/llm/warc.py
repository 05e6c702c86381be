"""WARC archives compressed by Zstandard: one frame for each record, the dictionary in a skippable frame ahead.

Writer and reader work on archives of bounded size, each a binary value of one row; the rows pass
through the shared folder between writing and reading.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_or_shuffled

#: Fixed values of the formats.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION, VERSIONS = b"WARC/1.1", (b"WARC/1.1", b"WARC/1.0")
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: Payloads that repeat up to which their largest keys are broadcast.
BROADCAST_ROWS = 100_000
#: An archive is closed once its records come to so many bytes; a dictionary has so many, trained on so many bytes of records.
ARCHIVE_BYTES, DICT_BYTES, SAMPLE_BYTES = 4 << 20, 16 << 10, 1 << 20


class BadArchive(ValueError):
    """The archive breaks the format, or a length or digest doesn't hold."""


def sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def uri(url: str) -> str:
    """White space and controls can't stand in a header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, number: int = 0, refers_url: str | None = None) -> bytes:
    """A response record of an HTTP message, or a revisit record of its head alone. `number` tells records of equal pages apart."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{url}:{number}")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", uri(url)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", SAME), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", str(refers_to))]
        if refers_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", uri(refers_url)))
    fields += [("WARC-Payload-Digest", sha1_32(payload)), ("WARC-Block-Digest", sha1_32(block)), ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"", block]) + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary of the samples; their plain text where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICT_BYTES] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(records: list[bytes]) -> bytes:
    samples, size = [], 0
    for r in records:
        samples.append(r[: 16 << 10])
        size += len(samples[-1])
        if size > SAMPLE_BYTES:
            break
    words = train(samples)
    data = words.as_bytes()
    packer = zstandard.ZstdCompressor(level=3, dict_data=words, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICT_MAGIC, len(data)), data, *map(packer.compress, records)])


def frames(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, a frame each, by the dictionary in its leading skippable frame where it has one. Other skippable frames are passed over."""
    if not archive:
        raise BadArchive("an empty archive")
    words, at = None, 0
    if archive[:4] == struct.pack("<I", DICT_MAGIC):
        size = struct.unpack_from("<I", archive, 4)[0] if len(archive) >= 8 else len(archive)
        if 8 + size > len(archive):
            raise BadArchive("the dictionary is cut off")
        data, at = archive[8 : 8 + size], 8 + size
        if data[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may be a frame itself
            data = zstandard.ZstdDecompressor().decompress(data)
        kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        words = zstandard.ZstdCompressionDict(data, dict_type=kind)
    opener = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    view = memoryview(archive)
    while at < len(archive):
        if archive[at + 1 : at + 4] == b"\x2a\x4d\x18" and 0x50 <= archive[at] <= 0x5F:
            if at + 8 > len(archive) or (at := at + 8 + struct.unpack_from("<I", archive, at + 4)[0]) > len(archive):
                raise BadArchive("the last frame is cut off")
            continue
        frame, parts = opener.decompressobj(), []
        try:
            while not frame.eof:
                if at >= len(archive):
                    raise BadArchive("the last frame is cut off")
                piece = view[at : at + (16 << 10)]
                parts.append(frame.decompress(piece))
                at += len(piece) - len(frame.unused_data)
        except zstandard.ZstdError as e:
            raise BadArchive(str(e)) from e
        yield b"".join(parts)


def holds(told: str | None, data: bytes) -> bool:
    """Whether a digest header agrees with the data; one that isn't there, or of an algorithm that isn't known here, doesn't disagree."""
    name, _, value = (told or "").partition(":")
    if name.lower() not in ("sha1", "md5", "sha256"):
        return True
    raw = hashlib.new(name.lower(), data).digest()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def sha1_of(told: str | None) -> str | None:
    """The SHA-1 in a digest header as lower-case hex; null where it names none."""
    name, _, value = (told or "").partition(":")
    if name.lower() != "sha1":
        return None
    return value.lower() if re.fullmatch(r"[0-9A-Fa-f]{40}", value) else base64.b32decode(value.upper()).hex()


def read_record(data: bytes) -> dict:
    """Fields of one record (names in lower case) with `block`, `payload` (None in a revisit), `payload-length` and `payload-sha1`, its lengths and digests checked.

    The payload of an HTTP message is its body, of other records the block. Header lines may go on in the next one; digests and the body's length may lack.
    """
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    if not found or lines[0] not in VERSIONS:
        raise BadArchive("no WARC version line")
    fields: dict = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise BadArchive("a header line has no colon")
        fields[k.strip().lower().decode()] = v.strip().decode()
    for must in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if must not in fields:
            raise BadArchive(f"no {must}")
    if not fields["content-length"].isdecimal() or (n := int(fields["content-length"])) + 4 != len(rest) or rest[n:] != b"\r\n\r\n":
        raise BadArchive("the block doesn't have the length that its header says")
    block = rest[:n]
    if not holds(fields.get("warc-block-digest"), block):
        raise BadArchive("the block's digest doesn't hold")
    payload, length, revisit = block, len(block), fields["warc-type"] == "revisit"
    if fields.get("content-type", "").lower().startswith("application/http") and not (revisit and not block):
        http, found, payload = block.partition(b"\r\n\r\n")
        if not found:
            raise BadArchive("no HTTP head")
        told = re.search(rb"(?i)\r\nContent-Length:[ \t]*(\d+)[ \t]*(?=\r\n|$)", http)
        length = int(told[1]) if told else None if revisit else len(payload)
        if not revisit and length != len(payload):
            raise BadArchive("the payload's length doesn't hold")
    if revisit:
        fields |= {"payload": None, "payload-length": length, "payload-sha1": sha1_of(fields.get("warc-payload-digest"))}
        if payload and fields.get("warc-profile", "").endswith("/identical-payload-digest"):
            raise BadArchive("a revisit holds a payload")
    elif not holds(fields.get("warc-payload-digest"), payload):
        raise BadArchive("the payload's digest doesn't hold")
    else:
        fields |= {"payload": payload, "payload-length": length, "payload-sha1": hashlib.sha1(payload).hexdigest()}
    return fields | {"block": block}


def plan_records(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (binary), refers_to and refers_url (null for a response).

    Of rows with equal payloads of at least `least` bytes, those with the largest key are responses.
    Keys are compared by the digest of the payload with partial maxima, which only payloads that repeat keep. They are
    sent to the rows where these lie while they are few; beyond that the join back, of rows with a large payload alone, is one
    that adaptive execution splits where a payload is very common. A null payload is empty, a null key the smallest.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    digest = F.when(F.octet_length("payload") >= least, F.sha2("payload", 256))
    keyed = rows.select("page_id", "url", digest.alias("__d")).where(F.col("__d").isNotNull())
    tops = keyed.groupBy("__d").agg(F.max(F.struct("page_id", "url")).alias("__to"), F.count("*").alias("__n")).where((F.col("__n") > 1) & F.col("__to.page_id").isNotNull())
    largest = small_or_shuffled(cut(tops.select("__d", "__to")), BROADCAST_ROWS)
    known = rows.withColumn("__d", digest)
    none = F.lit(None)
    short = known.where(F.col("__d").isNull()).select("page_id", "url", "payload", none.cast(pages.schema[key].dataType).alias("refers_to"), none.cast("string").alias("refers_url"))
    long = known.where(F.col("__d").isNotNull()).join(largest, "__d", "left")
    again = ~F.col("page_id").eqNullSafe(F.col("__to.page_id")) & F.col("__to").isNotNull()
    return long.select("page_id", "url", "payload", F.when(again, F.col("__to.page_id")).alias("refers_to"), F.when(again, F.col("__to.url")).alias("refers_url")).unionByName(short)


def write_archives(records: DataFrame) -> DataFrame:
    """(archive binary) rows of page_id, url, payload, refers_to, refers_url rows."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in rows:
            for p, u, body, to, to_url, number in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(record(p, u, body, to, to is not None, number, to_url))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([write_archive(held)], pa.binary())], names=["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([write_archive(held)], pa.binary())], names=["archive"])

    numbered = records.withColumn("number", F.monotonically_increasing_id())
    return numbered.select("page_id", "url", "payload", "refers_to", "refers_url", "number").mapInArrow(run, "archive binary")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive binary) of the .warc.zst files at a path, in a folder or of a pattern."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select(F.col("content").alias("archive"))


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of any type: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for (null in a revisit)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + payloads]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + payloads]
    number = lambda x: None if x is None else int(x)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for archive in b.column(0):
                out = []
                for data in frames(archive.as_py()):
                    r = read_record(data)
                    out.append((number(r.get("x-page-id")), r.get("warc-target-uri"), r["payload-length"], r["payload-sha1"], r["warc-type"], number(r.get("x-refers-to-page-id")), r["payload"]))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    return archives.select("archive").mapInArrow(run, schema)


def round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", least: int = REVISIT_BYTES) -> DataFrame:
    """The records of all pages, written to archives in the shared folder and read back.

    A null page_id or url stays null; a null payload is empty. Repeated rows have a record each, with ids of their own. An
    empty table gives no archive and no row; columns besides key, payload and url play no part.
    """
    return read_archives(cut(write_archives(plan_records(pages, key, payload, url, least))))
