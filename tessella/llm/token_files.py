"""Token ids of documents in Huffman-coded block files, in ascending order of doc_id.

Layout of a token store, a folder in a file system that Spark can write:

* ``codes``: Parquet (token int, bits int), the canonical code of the whole corpus. Codes of one length follow each
  other by token; shorter codes come first.
* ``blocks``: Parquet (segment int, block int, ids long, data binary). Segments are the partitions of a range partitioning by
  doc_id, in ascending order; blocks split a segment; ``data`` can be decoded without any other block::

      b"TKB2", uint32 documents D, uint32 checkpoints K, uint64 ids of the segment before the block
      int64[D] doc_id, uint8[D] 1 where doc_id is null, uint32[D] ids of the document
      uint64[K] bit offset of every STRIDE-th id of a document, from the start of the code bytes
      code bytes, each document from a byte boundary; uint32 CRC-32 of all that stands before

* ``segments``: Parquet (segment int, start long), the ids before each segment.

Spark's Parquet writer is used as the container, so that writes commit atomically and lost tasks run again.

Edge cases: a null text is encoded as the empty text; a null doc_id sorts first; repeated rows are separate documents;
an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, discard, settle
from .tokens import encoder

#: Longest code in bits; a decoding table has 2 to this power entries.
LIMIT = 20
#: Ids between two bit-offset checkpoints of a document.
STRIDE = 256
#: Code bytes after which a block is closed.
BLOCK = 1 << 20
#: Token-id bytes for each segment of the doc_id range.
SEGMENT = 16 << 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits for positive counts (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols have no codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)
    own, row = [], np.zeros(0)
    for _ in range(limit):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        joined = np.concatenate([weights, pairs])
        place = np.argsort(joined, kind="stable")
        own.append(place < n)
        row = joined[place]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_own in reversed(own):
        mine = int(is_own[:take].sum())
        lengths[:mine] += 1
        take = 2 * (take - mine)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code: words to write, and a table that maps the next LIMIT bits to a token and its bits."""

    def __init__(self, tokens: np.ndarray, bits: np.ndarray) -> None:
        order = np.lexsort((tokens, bits))
        self.tokens, self.bits = tokens[order].astype(np.int64), bits[order].astype(np.int64)
        self.limit = int(self.bits[-1]) if len(bits) else 1
        spans = np.left_shift(1, self.limit - self.bits)
        first = np.cumsum(spans) - spans
        size = int(self.tokens.max()) + 1 if len(bits) else 0
        self.word, self.length = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.word[self.tokens], self.length[self.tokens] = first >> (self.limit - self.bits), self.bits
        self._spans = spans

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        token, bits = np.zeros(1 << self.limit, np.uint32), np.ones(1 << self.limit, np.int64)
        n = int(self._spans.sum())
        token[:n], bits[:n] = np.repeat(self.tokens, self._spans), np.repeat(self.bits, self._spans)
        return token, bits

    def encode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Code bytes of documents in a row, their byte offsets, and the bit offset of each id."""
        length = self.length[ids]
        before = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(length, out=before[1:])
        size = (np.diff(before[offsets]) + 7) // 8
        at = np.zeros(len(offsets), np.int64)
        np.cumsum(size, out=at[1:])
        place = before[:-1] + np.repeat(8 * at[:-1] - before[offsets[:-1]], np.diff(offsets))
        n = int(at[-1]) // 4 + 2
        cell, free = place >> 5, 64 - length - (place & 31)
        wide = self.word[ids] << np.minimum(free, 63)
        high = np.bincount(cell, (wide >> 32) & 0xFFFFFFFF, n)
        high[1:] += np.bincount(cell, wide & 0xFFFFFFFF, n)[:-1]
        return high[:n].astype(">u4").tobytes()[: int(at[-1])], at, place


def _tokenize(name: str, end: int):
    def run(parts):
        enc = encoder(name)
        for part in parts:
            keys, texts = part.column(0), [t or "" for t in part.column(1).to_pylist()]
            for a, b in batches(texts):
                ids, at = enc.encode(texts[a:b])
                rows = [np.append(ids[x:y], end).astype("<u4" if enc.kind.itemsize == 4 else "<u2") for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch([keys.slice(a, b - a), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return run


def tokenize(docs: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of each whole text with the end id, as unsigned little-endian integers."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_tokenize(vocabulary, end), "doc_id long, n_tokens long, ids binary")


def _count(kind: str):
    def run(parts):
        total = np.zeros(1, np.int64)
        for part in parts:
            for row in part.column(0):
                found = np.bincount(np.frombuffer(row.as_buffer(), kind))
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], ["token", "n"])

    return run


def _coded(kind: str, words: Code, part):
    """(doc_id, n_tokens, checkpoints, code bytes) of the documents of an Arrow batch, some at a time."""
    keys, sizes, low = part.column(0).to_pylist(), part.column(1).to_numpy(), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(np.cumsum(sizes[low:]), 400_000)) + low)
        offsets = np.concatenate([[0], np.cumsum(sizes[low:high])])
        ids = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in part.column(2).slice(low, high - low)])
        raw, at, place = words.encode(ids, offsets)
        for key, a, b, x, y in zip(keys[low:high], offsets[:-1], offsets[1:], at[:-1], at[1:], strict=True):
            yield key, int(b - a), (place[a:b:STRIDE] - 8 * x).astype("<u8").tobytes(), raw[x:y]
        low = high


def _block(start: int, rows: list[tuple]) -> bytes:
    sizes = np.array([len(r[3]) for r in rows], np.int64)
    at = np.cumsum(sizes) - sizes
    points = np.concatenate([np.frombuffer(r[2], "<u8") + np.uint64(8 * a) for r, a in zip(rows, at, strict=True)])
    keys = np.array([r[0] or 0 for r in rows], "<i8")
    nulls = np.array([r[0] is None for r in rows], "u1")
    head = struct.pack("<4sIIQ", b"TKB2", len(rows), len(points), start)
    body = b"".join([head, keys.tobytes(), nulls.tobytes(), np.array([r[1] for r in rows], "<u4").tobytes(), points.astype("<u8").tobytes(), *[r[3] for r in rows]])
    return body + struct.pack("<I", zlib.crc32(body))


def _write(kind: str, code):
    def run(parts):
        segment, block, start, rows, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def close():
            nonlocal block, start, rows, size
            n = sum(r[1] for r in rows)
            out = pa.record_batch([pa.array([segment], pa.int32()), pa.array([block], pa.int32()), pa.array([n]), pa.array([_block(start, rows)], pa.binary())], ["segment", "block", "ids", "data"])
            block, start, rows, size = block + 1, start + n, [], 0
            return out

        for part in parts:
            for row in _coded(kind, code.value, part):
                if size >= BLOCK:
                    yield close()
                rows.append(row)
                size += len(row[3])
        if rows:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int) -> None:
    """Encodes every document and writes the token store at path.

    The written ids are counted, dealt by ranges of (doc_id, row), so that a doc_id that many rows share is split, and coded
    in order. The driver holds the code, which the vocabulary bounds.
    """
    spark = docs.sparkSession
    ids = settle(tokenize(docs, vocabulary, end).withColumn("row", F.monotonically_increasing_id()), "ids")
    kind = f"<u{2 if encoder(vocabulary).kind.itemsize == 2 else 4}"
    counts = ids.select("ids").mapInArrow(_count(kind), "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    tokens, bits = counts["token"].to_numpy(np.int64), code_lengths(counts["n"].to_numpy(np.int64))
    spark.createDataFrame([(int(t), int(b)) for t, b in zip(tokens, bits, strict=True)], "token int, bits int").coalesce(1).write.parquet(f"{path}/codes")
    segments = max(1, math.ceil(int(counts["n"].sum()) * int(kind[2]) / SEGMENT))
    code, order = spark.sparkContext.broadcast(Code(tokens, bits)), [F.col("doc_id").asc_nulls_first(), F.col("row")]
    ordered = ids.repartitionByRange(segments, *order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids")
    ordered.mapInArrow(_write(kind, code), "segment int, block int, ids long, data binary").write.option("compression", "none").parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("segment").agg(F.sum("ids").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    sizes.select("segment", F.coalesce(earlier, F.lit(0)).alias("start")).coalesce(1).write.parquet(f"{path}/segments")
    discard(ids)


def decode_block(data: bytes, table: tuple[np.ndarray, np.ndarray], limit: int) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """Start in the segment, doc_ids, ids in a row and their offsets; all checkpoints of the block are decoded side by side."""
    magic, n, k, start = struct.unpack_from("<4sIIQ", data)
    if magic != b"TKB2" or zlib.crc32(memoryview(data)[:-4]) != struct.unpack_from("<I", data, len(data) - 4)[0]:
        raise ValueError("damaged token block")
    at = struct.calcsize("<4sIIQ")
    keys, at = np.frombuffer(data, "<i8", n, at), at + 8 * n
    nulls, at = np.frombuffer(data, "u1", n, at), at + n
    sizes, at = np.frombuffer(data, "<u4", n, at).astype(np.int64), at + 4 * n
    points, at = np.frombuffer(data, "<u8", k, at).astype(np.int64), at + 8 * k
    raw = np.frombuffer(data, np.uint8, len(data) - 4 - at, at).astype(np.uint32)
    raw = np.concatenate([raw, np.zeros(8, np.uint32)])
    window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    runs = (sizes + STRIDE - 1) // STRIDE
    counts = np.full(k, STRIDE, np.int64)
    counts[np.cumsum(runs)[runs > 0] - 1] = (sizes - (runs - 1) * STRIDE)[runs > 0]
    order = np.argsort(-counts, kind="stable")
    place, left = points[order], counts[order]
    live = np.searchsorted(-left, -np.arange(STRIDE), "left")
    token, bits = table
    out = np.zeros((STRIDE, k), np.uint32)
    down = np.uint32(32 - limit)
    for step in range(int(left[0]) if k else 0):
        p = place[: live[step]]
        found = (window[p >> 3] << (p & 7).astype(np.uint32)) >> down
        out[step, : live[step]] = token[found]
        p += bits[found]
    lanes = np.empty((k, STRIDE), np.uint32)
    lanes[order] = out.T
    ids = lanes[np.arange(STRIDE) < counts[:, None]]
    return start, [None if z else int(x) for x, z in zip(keys, nulls, strict=True)], ids, np.concatenate([[0], np.cumsum(sizes)])


def _read(code, digest: bool):
    def run(parts):
        table, limit = code.value.table(), code.value.limit
        for part in parts:
            for data, before in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                start, keys, ids, at = decode_block(data.as_buffer(), table, limit)
                rows = [ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                last = pa.array([zlib.crc32(r) for r in rows], pa.int64()) if digest else pa.array(rows, pa.binary())
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(before + start + at[:-1]), pa.array(np.diff(at)), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a token store; with digest ids_crc32 in place of ids.

    start is the number of ids of all documents before; ids are unsigned little-endian 32-bit integers. The table of
    segments, a row of 12 bytes for each SEGMENT bytes of ids, is broadcast.
    """
    codes = spark.read.parquet(f"{path}/codes").toPandas()
    code = spark.sparkContext.broadcast(Code(codes["token"].to_numpy(np.int64), codes["bits"].to_numpy(np.int64)))
    last = "ids_crc32 long" if digest else "ids binary"
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(spark.read.parquet(f"{path}/segments")), "segment").select("data", "start")
    return blocks.mapInArrow(_read(code, digest), f"doc_id long, start long, n_tokens long, {last}")
