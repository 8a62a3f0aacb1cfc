"""Exact top-k search by integer inner product with vector-approximation files.

Components are turned into floor(1024 * x). Every dimension's range over all vectors is cut into CELLS cells, and a
vector's approximation is the number of its cell in each dimension, one byte. Approximations are written once, packed into
chunks of at most CHUNK bytes; queries are packed into blocks.

1. Each pair of a chunk and a block is a task that scans the cells, never the vectors: the score with the cells' middles is off by
   at most half a cell's width times the query in each dimension. What cannot be among the k best of the chunk by these
   bounds is passed over; over all chunks the k-th largest lower bound of a query is its first limit.
2. Exact vectors are read in the order of the upper bounds: first the k highest of each query, whose k-th exact score is the
   limit of the second read. What is left unread after that has a bound below it, so the result is certain.

Within a chunk at most k rows of an id, and of equal vectors the 2k rows with the smallest ids are kept: even without a query's own
rows these hold the k best, and others could never be among them.

Edge cases: null vectors, vectors with null or non-finite components, vectors without components and rows with a null id
take no part; vectors of different length are not compared; rows that repeat an id are candidates each, but
never for that id's query; ties go to the smaller vec_id; with fewer than k candidates all are returned; an empty table
gives no rows; other columns are ignored. Components must be below 2^20 in size so that scores fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settle

SCALE, CELLS = 1024, 256
#: Bytes of cells in a chunk, and of queries in a block.
CHUNK, BLOCK = 1 << 20, 1 << 20


def grid(vectors: DataFrame) -> DataFrame:
    """(vec_id, dims, x): the vectors that take part, as arrays of integers."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    return kept.select("vec_id", F.size("embedding").alias("dims"), F.transform("embedding", lambda v: F.floor(v * SCALE)).alias("x"))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _by_length(parts):
    """(length, rows) of an Arrow iterator whose second column is the length of the vectors."""
    for part in parts:
        dims = part.column(1).to_numpy()
        for d in np.unique(dims):
            yield int(d), part.filter(pa.array(dims == d))


def _extremes(parts):
    """The least and largest component of each dimension in this partition."""
    low: dict[int, np.ndarray] = {}
    high: dict[int, np.ndarray] = {}
    for d, rows in _by_length(parts):
        x = _matrix(rows.column(2))
        low[d], high[d] = (np.minimum(low[d], x.min(0)), np.maximum(high[d], x.max(0))) if d in low else (x.min(0), x.max(0))
    for d in low:
        yield pa.record_batch([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(low[d]), pa.array(high[d])], ["dims", "at", "low", "high"])


class Cells:
    """The grid of cells of vectors of one length."""

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        self.low = low.astype(np.float64)
        self.step = np.maximum((high - self.low + 1) / CELLS, 1e-9)

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.low) / self.step, 0, CELLS - 1).astype(np.uint8)

    def bounds(self, q: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the cells' middles for each query, and how far from them the exact scores may be."""
        q = q.astype(np.float64)
        middle = (q @ (self.low + self.step / 2))[:, None] + (q * self.step) @ cells.T.astype(np.float64)
        size = np.abs(q) @ (np.abs(self.low) + CELLS * self.step)
        return middle, np.abs(q) @ (self.step / 2) * (1 + 1e-9) + 1e-12 * size + 1


def _fit(rows: DataFrame) -> dict[int, Cells]:
    """The cells of each vector length; the driver gets two numbers for each dimension."""
    found = rows.select("vec_id", "dims", "x").mapInArrow(_extremes, "dims int, at int, low long, high long").groupBy("dims", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    return {int(d): Cells(*(g.sort_values("at")[c].to_numpy() for c in ("low", "high"))) for d, g in found.groupby("dims")}


def places(begins: np.ndarray) -> np.ndarray:
    """The place of each row in its run, from 0 on; begins marks the first row of each."""
    at = np.arange(len(begins))
    return at - np.maximum.accumulate(np.where(begins, at, 0))


def _approximate(grids, k: int):
    names = ["dims", "ids", "rows", "cells"]

    def run(parts):
        for d, rows in _by_length(parts):
            for low in range(0, rows.num_rows, max(1, CHUNK // d)):
                piece = rows.slice(low, max(1, CHUNK // d))
                x, ids = _matrix(piece.column(2)), piece.column(0).to_numpy()
                order = np.lexsort((ids, *x.T))
                fresh = np.append(True, (np.diff(x[order], axis=0) != 0).any(1))
                # At most k rows of an id; of equal vectors so many that k are left when any one id is taken away.
                some = order[places(fresh | np.append(True, np.diff(ids[order]) != 0)) < k]
                keep = some[places(np.append(True, (np.diff(x[some], axis=0) != 0).any(1))) < 2 * k] if len(some) else some
                yield pa.record_batch([pa.array([d], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (ids[keep], piece.column(3).to_numpy()[keep], grids.value[d].of(x[keep])))], names)

    return run


def _pack_queries(parts):
    for d, rows in _by_length(parts):
        for low in range(0, rows.num_rows, max(1, BLOCK // (8 * d))):
            piece = rows.slice(low, max(1, BLOCK // (8 * d)))
            yield pa.record_batch([pa.array([d], pa.int32()), pa.array([piece.column(0).to_numpy().tobytes()], pa.binary()), pa.array([_matrix(piece.column(2)).tobytes()], pa.binary())], ["dims", "ids", "x"])


def _scan(grids, k: int):
    """(query_id, dims, row, vec_id, lower, upper) of what may be among a query's k best of the chunk."""

    def run(key: tuple, queries: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for c in chunks.itertuples():
            ids, rows = np.frombuffer(c.ids, np.int64), np.frombuffer(c.rows, np.int64)
            cells, grid_ = np.frombuffer(c.cells, np.uint8).reshape(len(ids), -1), grids.value[c.dims]
            for b in queries.itertuples():
                own = np.frombuffer(b.ids, np.int64)
                q = np.frombuffer(b.x, np.int64).reshape(len(own), -1)
                for low in range(0, len(q), 32):
                    middle, slack = grid_.bounds(q[low : low + 32], cells)
                    for i, score in enumerate(middle):
                        score = np.where(ids == own[low + i], -np.inf, score)
                        m = min(k, int(np.isfinite(score).sum()))
                        if m:
                            may = np.flatnonzero(score >= np.partition(score, len(score) - m)[len(score) - m] - 2 * slack[i])
                            may = may[np.isfinite(score[may])]
                            out.append((np.full(len(may), own[low + i]), rows[may], ids[may], score[may] - slack[i], score[may] + slack[i]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 5
        found = pd.DataFrame(dict(zip(["query_id", "row", "vec_id", "lower", "upper"], cols, strict=True))).astype({"query_id": "int64", "row": "int64", "vec_id": "int64"})
        found.insert(1, "dims", np.int32(key[0] if key[0] is not None else 0))
        return found

    return run


def _exact(pairs: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, vec_id, row, score) of pairs; the exact vectors of these rows only are sent."""
    full = pairs.join(rows.select("row", "x"), "row").join(asked.select(F.col("vec_id").alias("query_id"), "dims", F.col("x").alias("q")), ["query_id", "dims"])
    score = F.aggregate(F.zip_with("x", "q", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, v: s + v)
    return full.select("query_id", "vec_id", "row", score.alias("score"))


def _best(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each query; Spark's group limit keeps k of each query in every task before the shuffle."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("nth") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k best rows of vectors with another id.

    Each query is sent to every chunk, each chunk to every block of queries, never row by row: chunks and blocks are dealt by hash
    into as many slots as there are of them, and every two slots meet in a task.
    """
    spark = vectors.sparkSession
    rows = settle(grid(vectors).withColumn("row", F.monotonically_increasing_id()), "exact")
    asked = settle(grid(queries).dropDuplicates(["vec_id"]), "asked")
    grids = spark.sparkContext.broadcast(_fit(rows))
    cells = rows.select("vec_id", "dims", "x", "row").mapInArrow(_approximate(grids, k), "dims int, ids binary, rows binary, cells binary")
    cells = settle(cells.withColumn("chunk", F.monotonically_increasing_id()), "cells")
    blocks = settle(asked.mapInArrow(_pack_queries, "dims int, ids binary, x binary").withColumn("block", F.monotonically_increasing_id()), "blocks")
    # One row for each vector length.
    sizes = F.broadcast(cells.groupBy("dims").agg(F.count("*").alias("chunks")).join(blocks.groupBy("dims").agg(F.count("*").alias("blocks")), "dims"))
    keys = ["dims", "i", "j"]

    def slots(side: DataFrame, number: str, own: str, mine: str, other: str, theirs: str) -> DataFrame:
        dealt = side.join(sizes, "dims").withColumn(own, F.pmod(F.xxhash64(number), F.col(mine))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(theirs) - 1)))
        return dealt.select(*keys, *[c for c in side.columns if c not in ("dims", number)])

    left, right = slots(blocks, "block", "i", "blocks", "j", "chunks"), slots(cells, "chunk", "j", "chunks", "i", "blocks")
    left, right = (x.toDF(*x.columns) for x in (left, right))
    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(_scan(grids, k), "query_id long, dims int, row long, vec_id long, lower double, upper double")
    found = settle(found, "bounds")
    limits = _best(found, k, F.desc("lower"), "row").groupBy("query_id").agg(F.when(F.count("*") == k, F.min("lower")).alias("limit"))
    able = found.join(limits, "query_id").where("limit is null or upper >= limit").select("query_id", "dims", "row", "vec_id", "upper")
    nearest = settle(_best(able, k, F.desc("upper"), "vec_id", "row"), "nearest")
    first = settle(_exact(nearest.select("query_id", "dims", "row", "vec_id"), rows, asked), "first")
    certain = first.groupBy("query_id").agg(F.min("score").alias("certain"))
    later = able.join(nearest.select("query_id", "row"), ["query_id", "row"], "left_anti").join(certain, "query_id").where("upper >= certain")
    scores = first.unionByName(_exact(later.select("query_id", "dims", "row", "vec_id"), rows, asked))
    best = settle(_best(scores, k, F.desc("score"), "vec_id"), "best")
    discard(cells, blocks, found, nearest, first, rows, asked)
    return best.select("query_id", F.col("nth").cast("int").alias("rank"), "vec_id", "score")
