"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with whole WARC/1.1 records, and at its end a skippable frame
with the seek table of the public seekable format: for each frame uint32 compressed size, uint32 decompressed size, then
uint32 number of frames, one descriptor byte, uint32 magic 0x8F92EAB1. Any Zstandard tool decompresses a bundle whole.
An index maps record identifiers to bundle, frame and offset in the decompressed frame, so that one record is read by
decompressing one frame.

Bundles and index are written by Spark's Parquet writer, one bundle of about BUNDLE bytes in a row, which makes writes
atomic and lets lost tasks run again; ``data`` of a row is the bundle file's content. ``export`` writes each bundle as a
``.warc.zst`` file of its own to any store that Arrow's file systems reach.

Of records with equal payloads the one with the largest page_id is a response, the others are revisits that refer to it
and hold no payload; their HTTP header still says the full length. The digest is the SHA-1 of the payload in base 32.

Edge cases: a null html is the empty payload; a null page_id is written without one and comes back null, it never is a
response that others refer to unless all its copies are null; of repeated rows with the largest page_id each is a
response; a null url is left out; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

FRAME, BUNDLE, LEVEL = 256 << 10, 8 << 20, 3
SEEK_MAGIC, SKIP_MAGIC = 0x8F92EAB1, 0x184D2A5E
#: Repeated digests that may be broadcast (about 60 bytes each); salts of a digest beyond that.
BROADCAST, SALTS = 500_000, 32
_PREFIX = "urn:page:"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def classify(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the response's page_id for revisits, else null.

    Only payloads of at least ``least`` bytes are told apart from their copies. The largest page_id of a digest is
    aggregated on the map side. Digests that repeat are broadcast up to BROADCAST of them, and no payload is shuffled;
    beyond that payloads are shuffled by digest and one of SALTS salts.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    known = rows.withColumn("digest", F.sha1("html"))
    first = known.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = settle(first, "repeated")
    if first.count() <= BROADCAST:
        met = known.join(F.broadcast(first), "digest", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
        met = known.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).join(first.withColumn("salt", salts), ["digest", "salt"], "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("first")), F.col("first"))
    return met.select("page_id", "url", "html", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record with its HTTP header block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_PREFIX}{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_PREFIX}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def bundle(frames: list[tuple[bytes, int]]) -> bytes:
    """Compressed frames with their decompressed sizes, and the seek table behind them."""
    table = b"".join(struct.pack("<II", len(f), n) for f, n in frames) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
    return b"".join(f for f, _ in frames) + struct.pack("<II", SKIP_MAGIC, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, read from the footer."""
    count, _, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    at, out = len(data) - 9 - 8 * count, []
    place = 0
    for i in range(count):
        size, full = struct.unpack_from("<II", data, at + 8 * i)
        out.append((place, size, full))
        place += size
    return out


def _bundle_rows(parts):
    packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
    frames, waiting, size, total, index = [], [], 0, 0, []

    def close():
        nonlocal waiting, size, total
        if waiting:
            raw = b"".join(waiting)
            frames.append((packer.compress(raw), len(raw)))
            total += len(frames[-1][0])
            waiting, size = [], 0

    def emit():
        nonlocal frames, total, index
        out = pa.record_batch([pa.array([bundle(frames)], pa.binary()), pa.array([index], kind)], ["data", "index"])
        frames, total, index = [], 0, []
        return out

    kind = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
    for part in parts:
        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            one = record(row[0], row[1], row[2].encode("utf-8", "replace"), row[3])
            index.append({"page_id": row[0], "frame": len(frames), "offset": size, "length": len(one)})
            waiting.append(one)
            size += len(one)
            if size >= FRAME:
                close()
                if total >= BUNDLE:
                    yield emit()
    close()
    if frames:
        yield emit()


def write_archive(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes bundles (bundle long, data binary, index array) of all records to path."""
    schema = "data binary, index array<struct<page_id: bigint, frame: int, offset: bigint, length: bigint>>"
    rows = classify(pages, least).mapInArrow(_bundle_rows, schema)
    rows.withColumn("bundle", F.monotonically_increasing_id()).write.option("compression", "none").parquet(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, bundle, frame, offset, length) of every record; payload bytes are not read."""
    return spark.read.parquet(path).select("bundle", F.inline("index")).select("page_id", "bundle", "frame", "offset", "length")


def read_record(data: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record of a bundle, by decompressing its frame alone."""
    place, size, _ = seek_table(data)[frame]
    return zstandard.ZstdDecompressor().decompress(data[place : place + size])[offset : offset + length]


def parse(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower case), block, and where the next record starts."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    size = int(head["content-length"])
    block = raw[end + 4 : end + 4 + size]
    if head["warc-block-digest"] != f"sha1:{base32_sha1(block)}" or raw[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError(f"damaged record at {at}")
    return head, block, end + 8 + size


def _page(text: str) -> int | None:
    own = text.strip("<>").removeprefix(_PREFIX)
    return int(own) if own else None


def _records(payloads: bool):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]

    def run(parts):
        opener = zstandard.ZstdDecompressor()
        for part in parts:
            for data in part.column(0).to_pylist():
                for place, size, full in seek_table(data):
                    raw, at, out = opener.decompress(data[place : place + size], max_output_size=full), 0, []
                    while at < len(raw):
                        head, block, at = parse(raw, at)
                        http, payload = block.split(b"\r\n\r\n", 1)
                        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        whole = head["warc-type"] == "response"
                        if whole and (len(payload) != length or base32_sha1(payload) != digest):
                            raise ValueError("damaged payload")
                        refers = _page(head["warc-refers-to"]) if "warc-refers-to" in head else None
                        out.append((_page(head["warc-record-id"]), length, digest, head["warc-type"], refers, *[payload if whole else None] * payloads))
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names)

    return run


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every record; payload is null for revisits."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return spark.read.parquet(path).select("data").mapInArrow(_records(payloads), schema)


def _files(target: str):
    def run(parts):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(target)
        for part in parts:
            names = [f"{folder}/bundle-{b:020d}.warc.zst" for b in part.column(0).to_pylist()]
            for name, data in zip(names, part.column(1), strict=True):
                # A task that runs twice writes the same bytes under the same name.
                with store.open_output_stream(name + ".part") as out:
                    out.write(data.as_buffer())
                store.move(name + ".part", name)
            yield pa.record_batch([part.column(0), pa.array(names), pa.array([len(x.as_buffer()) for x in part.column(1)], pa.int64())], ["bundle", "file", "bytes"])

    return run


def export(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Writes each bundle of an archive as one file of the folder that the uri ``target`` names (which exists, and which all
    executors reach), and gives (bundle, file, bytes)."""
    return settle(spark.read.parquet(path).select("bundle", "data").mapInArrow(_files(target), "bundle long, file string, bytes long"), "exported")
