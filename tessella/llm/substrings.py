"""Removal of passages that an earlier document holds too, by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the smallest hash of GRAM consecutive words in it; consecutive windows of a
document that share a minimiser are a super-k-mer: one packed string of words, sent to the bucket of its minimiser.

1. Documents are packed into chunks of about CHUNK bytes, words separated by one space, and written once with the places of their
   super-k-mers. A task tells how many bytes of these it has for each bucket; the number of buckets follows from the bytes of all texts.
2. A chunk sends each different super-k-mer once, with the smallest and largest doc_id that hold it, in one compressed message for each
   FINE neighbouring buckets. A bucket sorts the windows of its super-k-mers by hash, compares neighbours of equal hash word by word, and so
   knows the smallest doc_id of each window exactly. It answers each chunk with the windows that start in a smaller document than the
   largest one of the chunk's that hold them.
3. A bucket of more than four times its bytes (one frequent minimiser with ever new words around it) is not built: its windows are rows, whose smallest
   doc_id is an aggregate with partial sums in each task and is joined back, so that no window or minimiser meets in one task.
4. Each chunk meets its answers, removes the words covered, and digests what is left.

Edge cases: a null text has no words; a row with a null doc_id is compared with nothing and loses nothing; rows that repeat a
doc_id are judged each, and a window that only they share stays; documents shorter than a window lose nothing; an empty table
gives no rows; other columns are ignored. Windows are judged on the input: what one row loses does not depend on what others lose.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, mix64, settle

WINDOW, GRAM = 13, 2
#: Bytes of text of a chunk, and of super-k-mers of a bucket and of a message, which holds those of FINE buckets.
CHUNK, BUCKET, FINE = 2 << 20, 4 << 20, 8
#: Windows of a super-k-mer at most: longer runs of a minimiser (periodic texts) are cut into several of the same bucket.
RUN = 128
#: Bytes of super-k-mers for each byte of text, about.
OVERLAP = 3

_TABLE = np.zeros(256, bool)
_TABLE[[32, *range(9, 14)]] = True
_HASHER = WordHasher()
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def pack_texts(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """All words, each followed by one space, and the number of words of each text."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _TABLE[raw]
    # A white-space character counts where a word ends.
    ends = space.copy()
    ends[1:] &= ~space[:-1]
    ends[0] = False
    counts = np.add.reduceat(ends, at[:-1], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
    return np.where(space, np.uint8(32), raw)[~space | ends].tobytes(), counts


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of packed words."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    return np.append(0, ends[:-1] + 1)[: len(ends)], ends


def chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width consecutive hashes, made of those of runs half as long."""
    if width == 1:
        return hashes
    half = width // 2
    left, right = chain(hashes, width - half), chain(hashes, half)
    n = max(len(hashes) - width + 1, 0)
    return mix64(left[:n] * _ODD[0] + right[width - half :][:n] * _ODD[1])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width consecutive values."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


class SuperKmers:
    """The super-k-mers of packed documents: first window, number of windows, number among the different ones, and bucket of each."""

    def __init__(self, raw: bytes, counts: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        self.raw, self.first, self.size = raw, first, size
        self.starts, self.ends = word_spans(raw)
        self.doc = np.searchsorted(np.cumsum(counts), first, "right")
        self.which = self.bucket = np.zeros(0, np.int64)

    @classmethod
    def of(cls, raw: bytes, counts: np.ndarray, usable: np.ndarray, buckets: int) -> SuperKmers:
        """Finds them in the documents that are usable."""
        starts, ends = word_spans(raw)
        hashes = _HASHER.spans(raw, starts, ends)
        n, none = len(hashes) - WINDOW + 1, np.zeros(0, np.int64)
        at = none
        if n > 0:
            low = sliding_minimum(mix64(chain(hashes, GRAM)), WINDOW - GRAM + 1)
            doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
            at = np.flatnonzero((doc[:n] == doc[WINDOW - 1 :]) & usable[doc[:n]])
        if not len(at):
            return cls(raw, counts, none, none)
        change = np.append(True, (np.diff(at) != 1) | (low[at[1:]] != low[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]]))
        began = np.maximum.accumulate(np.where(change, np.arange(len(at)), 0))
        change |= (np.arange(len(at)) - began) % RUN == 0
        heads = np.flatnonzero(change)
        out = cls(raw, counts, at[heads], np.diff(np.append(heads, len(at))))
        out.bucket = (low[out.first] % np.uint64(buckets)).astype(np.int64)
        number: dict[bytes, int] = {}
        out.which = np.fromiter((number.setdefault(t, len(number)) for t in out.texts(np.arange(len(heads)))), np.int64, len(heads))
        return out

    @classmethod
    def stored(cls, raw: bytes, counts: np.ndarray, data: bytes) -> SuperKmers:
        """What store wrote."""
        first, size, which, bucket = _unpress(data)[0]
        out = cls(raw, counts, np.cumsum(first), size)
        out.which, out.bucket = np.cumsum(which), bucket
        return out

    def store(self) -> bytes:
        return _press(np.diff(self.first, prepend=0), self.size, np.diff(self.which, prepend=0), self.bucket)

    def texts(self, some: np.ndarray) -> list[bytes]:
        """The words of these super-k-mers."""
        low, high, raw = self.starts[self.first[some]].tolist(), self.ends[self.first[some] + self.size[some] + WINDOW - 2].tolist(), self.raw
        return [raw[a:b] for a, b in zip(low, high, strict=True)]

    def distinct(self) -> np.ndarray:
        """The first of each different super-k-mer, in the order of their numbers."""
        return np.unique(self.which, return_index=True)[1]

    def lengths(self, some: np.ndarray) -> np.ndarray:
        return self.ends[self.first[some] + self.size[some] + WINDOW - 2] - self.starts[self.first[some]] + 1

    def owners(self, ids: list) -> tuple[np.ndarray, np.ndarray]:
        """The smallest and largest doc_id that hold each different super-k-mer."""
        owner, n = np.array([i or 0 for i in ids], np.int64)[self.doc], int(self.which.max(initial=-1)) + 1
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, owner)
        np.maximum.at(high, self.which, owner)
        return low, high


def _chunked(parts) -> Iterator[tuple[list, list[bytes]]]:
    """Documents in chunks of about CHUNK bytes; a longer one is a chunk alone."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for part in parts:
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            text = text or b""
            if texts and size + len(text) > CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            size += len(text) + 16
    if texts:
        yield ids, texts


def _pack_chunks(buckets: int):
    """Rows of packed documents with their super-k-mers, and at the end one row with the bytes of these by bucket."""
    names = ["ids", "counts", "raw", "found", "bucket", "bytes"]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(parts):
        press, seen, sizes = zstandard.ZstdCompressor(3), [], []
        for ids, texts in _chunked(parts):
            raw, counts = pack_texts(texts)
            found = SuperKmers.of(raw, counts, np.array([i is not None for i in ids]), buckets)
            some = found.distinct()
            here, at = np.unique(found.bucket[some], return_inverse=True)
            seen.append(here)
            sizes.append(np.bincount(at, found.lengths(some), len(here)).astype(np.int64))
            yield pa.record_batch([pa.array([v], k) for v, k in zip((ids, counts.tolist(), press.compress(raw), found.store(), None, None), kinds, strict=True)], schema=schema)
        some, at = np.unique(np.concatenate([np.zeros(0, np.int64), *seen]), return_inverse=True)
        total = np.bincount(at, np.concatenate([np.zeros(0), *sizes]), len(some)).astype(np.int64)
        yield pa.record_batch([pa.array([v], k) for v, k in zip((None, None, None, None, some.tolist(), total.tolist()), kinds, strict=True)], schema=schema)

    return run


def _opened(part: pa.RecordBatch) -> Iterator[tuple[int, list, np.ndarray, SuperKmers, pa.RecordBatch]]:
    """chunk, ids, counts and super-k-mers of each row."""
    free = zstandard.ZstdDecompressor()
    for i in range(part.num_rows):
        row = part.slice(i, 1)
        counts, raw = np.array(row.column("counts")[0].as_py(), np.int64), free.decompress(row.column("raw")[0].as_py())
        yield row.column("chunk")[0].as_py(), row.column("ids")[0].as_py(), counts, SuperKmers.stored(raw, counts, row.column("found")[0].as_py()), row


def _press(*arrays: np.ndarray, text: bytes = b"") -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(3).compress(head + b"".join(a.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays) + text)


def _unpress(data: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, n, 8), 8 + 8 * n, []
    for size in sizes:
        planes = np.frombuffer(raw, np.uint8, 8 * int(size), at).reshape(8, -1)
        out.append(np.ascontiguousarray(planes.T).view(np.int64).ravel())
        at += 8 * int(size)
    return out, raw[at:]


def _send(hot):
    """(message, chunk, data): a chunk's different super-k-mers of every FINE buckets, but for hot ones."""

    def run(parts):
        large = np.array(sorted(hot.value), np.int64)
        for part in parts:
            for chunk, ids, _, found, _ in _opened(part):
                some, (low, high) = found.distinct(), found.owners(ids)
                order = np.argsort(found.bucket[some], kind="stable")
                order = order[~np.isin(found.bucket[some[order]], large)]
                bucket = found.bucket[some[order]]
                ends = np.flatnonzero(np.append(np.diff(bucket // FINE) != 0, True)) + 1 if len(order) else []
                rows, at = [], 0
                for end in ends:
                    mine = order[at:end]
                    rows.append((int(bucket[at]) // FINE, chunk, _press(bucket[at:end] % FINE, np.diff(mine, prepend=0), low[mine], high[mine] - low[mine], text=b"\n".join(found.texts(some[mine])))))
                    at = end
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["message", "chunk", "data"])

    return run


def window_spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of super-k-mers: the bytes they lie in, start and end of each there, its super-k-mer, and its hash."""
    raw = b" ".join(texts) + b" "
    starts, ends = word_spans(raw)
    at = np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts]) - 1) + 1
    counts = np.diff(np.append(0, at)) - WINDOW + 1
    first = np.append(0, at[:-1])
    own = np.repeat(np.arange(len(texts)), counts)
    word = first[own] + np.arange(len(own)) - np.append(0, np.cumsum(counts)[:-1])[own]
    hashes = chain(_HASHER.spans(raw, starts, ends), WINDOW)[word]
    return raw, starts[word], ends[word + WINDOW - 1], own, hashes


def smallest_owner(texts: list[bytes], low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all windows of super-k-mers: the super-k-mer, and the smallest of low over all that hold the window. Windows are sorted by
    hash; neighbours of equal hash are compared as texts, and should two texts share a hash, they are told apart."""
    raw, begin, end, own, hashes = window_spans(texts)
    order = np.lexsort((low[own], hashes))
    fresh = np.append(True, np.diff(hashes[order]) != 0)
    again = np.flatnonzero(~fresh)
    for at in range(0, len(again), 65_536):
        this, that = order[again[at : at + 65_536]], order[again[at : at + 65_536] - 1]
        for a, b, c, d in zip(begin[this].tolist(), end[this].tolist(), begin[that].tolist(), end[that].tolist(), strict=True):
            if raw[a:b] != raw[c:d]:
                return _told_apart(raw, begin, end, own, low)
    heads = np.flatnonzero(fresh)
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(low[own[order[heads]]], np.diff(np.append(heads, len(order))))
    return own, least


def _told_apart(raw: bytes, begin: np.ndarray, end: np.ndarray, own: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best: dict[bytes, int] = {}
    windows = [raw[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
    for w, v in zip(windows, low[own].tolist(), strict=True):
        best[w] = min(v, best.get(w, v))
    return own, np.array([best[w] for w in windows], np.int64)


def _buckets(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """(chunk, data): for each chunk the windows of its super-k-mers that a smaller document holds too. One bucket after the other."""
    buckets, numbers, lows, highs, chunks, texts = [], [], [], [], [], []
    for chunk, data in zip(rows["chunk"], rows["data"], strict=True):
        (bucket, number, low, apart), text = _unpress(data)
        buckets.append(bucket)
        numbers.append(np.cumsum(number))
        lows.append(low)
        highs.append(low + apart)
        chunks.append(np.full(len(number), chunk))
        texts += text.split(b"\n")
    bucket, number, low, high, chunk = (np.concatenate(v) for v in (buckets, numbers, lows, highs, chunks))
    found = []
    for b in np.unique(bucket):
        mine = np.flatnonzero(bucket == b)
        own, least = smallest_owner([texts[i] for i in mine], low[mine])
        hit = np.flatnonzero(least < high[mine][own])
        nth = np.arange(len(own)) - np.searchsorted(own, np.arange(len(mine)))[own]
        found.append((chunk[mine[own[hit]]], number[mine[own[hit]]], nth[hit], least[hit]))
    return _answers(*(np.concatenate(v) for v in zip(*found, strict=True)))


def _answers(chunk: np.ndarray, number: np.ndarray, nth: np.ndarray, least: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((nth, number, chunk))
    ends = np.flatnonzero(np.append(np.diff(chunk[order]) != 0, True)) + 1 if len(order) else []
    out, at = [], 0
    for end in ends:
        mine = order[at:end]
        out.append((int(chunk[mine[0]]), _press(np.diff(number[mine], prepend=0), nth[mine], least[mine])))
        at = end
    return pd.DataFrame(out, columns=["chunk", "data"]).astype({"chunk": "int64"})


def _hot_windows(hot):
    """(chunk, number, nth, window, low, high): the windows of hot buckets, each once for each different super-k-mer of a chunk."""

    def run(parts):
        large = np.array(sorted(hot.value), np.int64)
        for part in parts:
            for chunk, ids, _, found, _ in _opened(part):
                heads, (low, high) = found.distinct(), found.owners(ids)
                mine = np.flatnonzero(np.isin(found.bucket[heads], large))
                for at in range(0, len(mine), 4096):
                    some = mine[at : at + 4096]
                    words, begin, end, own, _ = window_spans(found.texts(heads[some]))
                    nth = np.arange(len(own)) - np.searchsorted(own, np.arange(len(some)))[own]
                    windows = [words[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
                    yield pa.record_batch([pa.array(np.full(len(own), chunk)), pa.array(some[own]), pa.array(nth), pa.array(windows, pa.binary()), pa.array(low[some][own]), pa.array(high[some][own])], ["chunk", "number", "nth", "window", "low", "high"])

    return run


def _removed(ids: list, found: SuperKmers, answers: list[bytes]) -> np.ndarray:
    """Which words of a chunk go."""
    gone = np.zeros(len(found.starts) + 1, np.int64)
    if answers and len(found.first):
        parts = [_unpress(a)[0] for a in answers]
        number = np.concatenate([np.cumsum(p[0]) for p in parts])
        nth, least = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        order = np.argsort(number, kind="stable")
        number, nth, least = number[order], nth[order], least[order]
        low, high = np.searchsorted(number, found.which, "left"), np.searchsorted(number, found.which, "right")
        some = np.flatnonzero(high > low)
        again = np.repeat(some, (high - low)[some])
        at = np.arange(len(again)) - np.repeat(np.append(0, np.cumsum((high - low)[some])[:-1]), (high - low)[some]) + low[again]
        owner = np.array([i or 0 for i in ids], np.int64)[found.doc[again]]
        begin = (found.first[again] + nth[at])[least[at] < owner]
        np.add.at(gone, begin, 1)
        np.add.at(gone, begin + WINDOW, -1)
    return np.cumsum(gone[:-1]) > 0


def _finish(parts):
    """doc_id, n_words, n_removed, kept (the words left, separated by one space) of each document."""
    for part in parts:
        for _, ids, counts, found, row in _opened(part):
            gone = _removed(ids, found, row.column("answers")[0].as_py() or [])
            size = found.ends - found.starts + 1
            keep = np.frombuffer(found.raw, np.uint8)[np.repeat(~gone, size)].tobytes()
            ends = np.cumsum(counts)
            bytes_kept = np.append(0, np.cumsum(np.where(gone, 0, size)))
            lost = np.append(0, np.cumsum(gone))
            n_removed = lost[ends] - lost[ends - counts]
            kept = [keep[a : max(a, b - 1)] for a, b in zip(bytes_kept[ends - counts].tolist(), bytes_kept[ends].tolist(), strict=True)]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(counts), pa.array(n_removed), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def _digested(parts):
    for part in parts:
        sums = pa.array([hashlib.sha256(k).hexdigest() for k in part.column("kept").to_pylist()], pa.string())
        yield pa.record_batch([*part.columns[:3], sums], ["doc_id", "n_words", "n_removed", "kept_sha256"])


KEPT = "doc_id long, n_words long, n_removed long, kept binary"


def removal(docs: DataFrame, bucket_bytes: int = BUCKET, limit: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept (UTF-8) of each row of docs. Buckets take about bucket_bytes; beyond limit (four times that) they are hot."""
    spark = docs.sparkSession
    limit = limit or 4 * bucket_bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = FINE * max(int(spark.conf.get("spark.sql.shuffle.partitions")), OVERLAP * size // (FINE * bucket_bytes) + 1)
    packed = rows.mapInArrow(_pack_chunks(buckets), "ids array<long>, counts array<long>, raw binary, found binary, bucket array<long>, bytes array<long>")
    packed = settle(packed.withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    chunks = packed.where("raw is not null").select("chunk", "ids", "counts", "raw", "found")
    loads = packed.where("raw is null").select(F.explode(F.arrays_zip("bucket", "bytes")).alias("z")).groupBy("z.bucket").agg(F.sum("z.bytes").alias("bytes"))
    # At most as many as limit goes into all super-k-mers.
    hot = {r["bucket"] for r in loads.where(F.col("bytes") > limit).collect()}
    sent = spark.sparkContext.broadcast(hot)
    found = chunks.mapInArrow(_send(sent), "message long, chunk long, data binary").groupBy("message").applyInPandas(_buckets, "chunk long, data binary")
    if hot:
        # Windows of hot buckets, each once for each different super-k-mer of a chunk.
        windows = settle(chunks.mapInArrow(_hot_windows(sent), "chunk long, number long, nth long, window binary, low long, high long"), "hot_windows")
        least = windows.groupBy("window").agg(F.min("low").alias("least"))
        hits = windows.join(least, "window").where("least < high").select("chunk", "number", "nth", "least")
        found = found.unionByName(hits.groupBy("chunk").applyInPandas(_packed_hits, "chunk long, data binary"))
    # A chunk's answers are bounded by its own windows.
    found = settle(found, "answers")
    answers = found.groupBy("chunk").agg(F.collect_list("data").alias("answers"))
    return chunks.join(answers, "chunk", "left").mapInArrow(_finish, KEPT)


def _packed_hits(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return _answers(*(rows[c].to_numpy(np.int64) for c in ("chunk", "number", "nth", "least")))


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, text): what is left of each document, its words separated by one space."""
    return removal(docs).select("doc_id", F.col("kept").cast("string").alias("text"))


def digests(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256."""
    return removal(docs, **options).mapInArrow(_digested, "doc_id long, n_words long, n_removed long, kept_sha256 string")
