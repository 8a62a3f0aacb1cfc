"""Helpers shared by the training-data operators: written intermediates, text normal form, word hashes."""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import shared_folder

#: ASCII white space: space and U+0009 to U+000D. A word is a maximal run of other characters.
SPACES = "\x20\x09-\x0d"
WORD = re.compile(f"[^{SPACES}]+")

#: Words longer than this many bytes are hashed one by one.
_LONG = 4096

def workspace(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes the folders of settled frames that nothing reads any more."""
    for df in frames:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of all words of many texts at once: eight bytes of every word at a time are mixed into its hash.

    The chain starts from the length, and no sum or product of the bytes decides a
    hash, so that regular words (as of two letters in a pattern) get different ones.
    """

    def __init__(self) -> None:
        table = np.zeros(256, bool)
        table[[32, *range(9, 14)]] = True
        self._space = table
        self._mask = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

    def spans(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges starts[i]:ends[i]."""
        eights = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), 0, (1,))
        size = (ends - starts).astype(np.int64)
        out = mix64(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        live, at = np.flatnonzero(size <= _LONG), 0
        while len(live):
            part = eights[starts[live] + at] & self._mask[np.minimum(size[live] - at, 8)]
            out[live] = mix64((out[live] ^ part) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xA0761D6478BD642F))
            at += 8
            live = live[size[live] > at]
        for i in np.flatnonzero(size > _LONG):
            out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and for text i the range offsets[i]:offsets[i + 1] of them."""
        parts = [t.encode("utf-8", "replace") for t in texts]
        at = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=at[1:])
        raw = b" ".join(parts) + b" "
        edge = np.diff(self._space[np.frombuffer(raw, np.uint8)].astype(np.int8), prepend=np.int8(1))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        return self.spans(raw, starts, ends), np.searchsorted(starts, at)


def batches(texts: list[str], limit: int = 400_000):
    """Index ranges of neighbouring texts with about limit characters together; a longer text stands alone."""
    low = size = 0
    for i, text in enumerate(texts):
        if i > low and size + len(text) > limit:
            yield low, i
            low, size = i, 0
        size += len(text)
    if low < len(texts):
        yield low, len(texts)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every endpoint of edges (a, b): the smallest id reachable.

    Alternates the large-star and small-star steps: each joins the edges with a per-vertex minimum, which is
    aggregated on the map side, so that a vertex with very many neighbours never meets in one task; the joins
    can be split by adaptive execution. Every round is cut by checkpoint().
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct().checkpoint()
    last = None
    for _ in range(rounds):
        both = e.union(e.select("b", "a").toDF("a", "b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.where("b > a").join(low, "a").where("b <> m").select(F.col("m").alias("a"), "b").distinct()
        down = big.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b")
        e = small.union(low.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    inner = e.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("id"), "component")
    return inner.union(e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
