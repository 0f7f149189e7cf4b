"""WARC archives as Zstandard files: one frame per record, the dictionary in a leading skippable frame.

Spark's own text writer writes the archives: a row is a whole archive (the dictionary's skippable frame and the record
frames behind it), which ends once it has ARCHIVE_BYTES, and a file holds one row. The line separator is an empty
skippable frame, which every Zstandard reader passes over. So they reach any store that Spark reaches, and a task holds
one archive at most, however many pages there are. The reader walks block headers to a frame's end, so an archive is
read once.

Records with equal payloads share one response, of the smallest page_id (every row of it, should one repeat); the
others are revisit records without payload. Only (page_id, digest) travels by digest: a payload that many pages share
moves no page to another's task. Null html is an empty payload; a row with a null page_id is a response only where no
row of its payload has an id. A very long page is one long record. Columns but page_id, url and html are not looked at.
An empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave.session import shared_dir

FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, range(0x184D2A50, 0x184D2A60), 0x184D2A5D
#: An empty skippable frame (magic 0x184D2A50, length 0); all its bytes are ASCII.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
DICT_BYTES, DICT_SAMPLE = 16 << 10, 1 << 20
LEVEL = 3
#: Compressed bytes after which an archive ends, so that one value holds it (and one record more at most).
ARCHIVE_BYTES = 32 << 20
RECORD = "page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary, archive string"
_PREFIX = "urn:x-page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    """A header value stands on one line."""
    return "".join(c if c.isprintable() else "%" + format(ord(c), "02X") for c in text)


def build_record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    block = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_PREFIX}{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", _line(uri or "")),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Payload-Length", str(len(payload))),
        ("WARC-Block-Digest", "sha1:" + digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        headers += [("WARC-Refers-To", f"<{_PREFIX}{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The record's fields; ValueError where version, headers, lengths or digests do not hold."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC version line")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(headers["Content-Length"])
    block = rest[:size]
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record of {len(rest)} bytes; its header says {size}")
    if headers["WARC-Block-Digest"] != "sha1:" + digest(block):
        raise ValueError("block digest")
    kind, payload = headers["WARC-Type"], None
    if kind == "response":
        http, found, payload = block.partition(b"\r\n\r\n")
        if not found or f"Content-Length: {len(payload)}" not in http.decode().split("\r\n"):
            raise ValueError("HTTP length")
        if headers["WARC-Payload-Digest"] != "sha1:" + digest(payload) or int(headers["WARC-Payload-Length"]) != len(payload):
            raise ValueError("payload digest or length")
    elif kind != "revisit" or block:
        raise ValueError(f"record type {kind}")
    number = lambda x: int(x[len(_PREFIX) + 1 : -1]) if x and len(x) > len(_PREFIX) + 2 else None
    return {"page_id": number(headers["WARC-Record-ID"]), "record_type": kind, "target_uri": headers["WARC-Target-URI"], "payload_bytes": int(headers["WARC-Payload-Length"]), "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": number(headers.get("WARC-Refers-To", "")), "payload": payload}


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, by its header and its block headers."""
    flags = data[at + 4]
    single, checksum, dictionary, content = flags >> 5 & 1, flags >> 2 & 1, flags & 3, flags >> 6
    at += 5 + (not single) + (0, 1, 2, 4)[dictionary] + (single, 2, 4, 8)[content]
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("frame is cut off")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)  # a run-length block holds one byte
    at += 4 * checksum
    if at > len(data):
        raise ValueError("frame is cut off")
    return at


def read_archive(data: bytes):
    """Records of one archive: the dictionary from the leading skippable frame, then frame after frame."""
    at, end = 0, len(data)
    decoder = zstandard.ZstdDecompressor()
    while at < end:
        magic = struct.unpack_from("<I", data, at)[0]
        if magic in SKIPPABLE:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if at + 8 + size > end:
                raise ValueError("skippable frame is cut off")
            if at == 0 and magic == DICTIONARY and size:
                content = data[at + 8 : at + 8 + size]
                if content[:4] == struct.pack("<I", FRAME):
                    content = zstandard.ZstdDecompressor().decompress(content)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            at += 8 + size
        elif magic == FRAME:
            stop = frame_end(data, at)
            yield parse_record(decoder.decompressobj().decompress(data[at:stop]))
            at = stop
        else:
            raise ValueError(f"no frame at byte {at}")


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples for that, the first one's beginning as plain content."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return samples[0][:DICT_BYTES]


def write_archives(pages: DataFrame, path: str) -> None:
    """Write (page_id, url, html) into ``path``, archives of ARCHIVE_BYTES."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"key": F.sha2("html", 256), "id": F.coalesce("page_id", F.lit(-(2**63)))})
    slim = rows.select("id", "page_id", "key")
    twice = slim.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    others = slim.join(twice, "key").where("page_id is null or page_id <> first").select("id", "key", "first").distinct()
    rows = rows.join(others, ["id", "key"], "left").select("page_id", "url", "html", "first")

    def build(batches):
        held, out, size, encoder = [], [], 0, None

        def start():
            content = _dictionary([x[:100_000] for x in held])
            encoder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content))
            return [struct.pack("<II", DICTIONARY, len(content)), content, *map(encoder.compress, held)], encoder

        def archive(frames):
            return pa.record_batch([pa.array([b"".join(frames)], pa.binary())], ["value"])

        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                record = build_record(page_id, url, html.encode(), first, first is not None)
                if encoder is None:
                    held.append(record)
                    size += len(record)
                    if size >= DICT_SAMPLE:
                        out, encoder = start()
                        held, size = [], sum(map(len, out))
                else:
                    out.append(encoder.compress(record))
                    size += len(out[-1])
                    if size >= ARCHIVE_BYTES:
                        yield archive(out)
                        held, out, size, encoder = [], [], 0, None
        if held:
            out, _ = start()
        if out:
            yield archive(out)

    # a binary's bytes stay as they are when it is cast to a string and written
    rows.mapInArrow(build, "value binary").select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR).option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of all archives in ``path``, validated; columns as in RECORD."""

    def read(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                for r in read_archive(data.as_py()):
                    rows.append(r | {"archive": name})
                    size += len(r["payload"] or b"")
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(read, RECORD)


_KINDS = {"page_id": pa.int64(), "record_type": pa.string(), "target_uri": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(), "archive": pa.string()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in _KINDS.items()], list(_KINDS))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives into the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path)
