"""Vectors as exact integers in packed form, and sums over partitions that are merged on executors before the driver sees them."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integers beyond this size are clipped to it.
LARGEST = 1 << 62
_WIDTHS = (np.dtype("i1"), np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """The rows whose embedding is not null, not empty and holds finite components only, with the embedding as doubles."""
    rows = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)


def scaled(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * c) of a column of vectors of one length."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) * float(scale))
    return np.clip(x, -float(LARGEST), float(LARGEST)).astype(np.int64)


def pack(x: np.ndarray) -> list[bytes]:
    """Each row as bytes: one for its width, then its components in the narrowest integers that hold them all."""
    size = np.maximum(x.max(1), -1 - x.min(1))
    width = np.searchsorted([127, 32767, 2**31 - 1], size)
    out: list[bytes] = [b""] * len(x)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        for i, row in zip(at, x[at].astype(_WIDTHS[w]), strict=True):
            out[i] = bytes([w]) + row.tobytes()
    return out


def unpack(rows: list[bytes], dims: int) -> np.ndarray:
    """What pack made of vectors of this length."""
    x = np.empty((len(rows), dims), np.int64)
    width = np.array([r[0] for r in rows], np.int64)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        x[at] = np.frombuffer(b"".join(rows[i][1:] for i in at), _WIDTHS[w]).reshape(len(at), dims)
    return x


def by_length(part: pa.RecordBatch, name: str = "dims") -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch for each vector length in it."""
    dims = part.column(name).to_numpy()
    for d in np.unique(dims):
        yield int(d), part.filter(pa.array(dims == d))


def exact_sums(x: np.ndarray) -> np.ndarray:
    """The sum of each column as Python integers, whatever their size."""
    if len(x) and int(np.abs(x).max()) * len(x) >= 1 << 62:
        x = x.astype(object)
    return np.array([int(v) for v in x.sum(0)], object)


#: Sums of one partition, by vector length.
PARTIALS = "dims int, part int, sums binary"


def partial(dims: int, sums: dict[str, object]) -> pa.RecordBatch:
    """A row of PARTIALS: named numbers or arrays, to be added to those of other partitions."""
    from pyspark import TaskContext

    task = TaskContext.get()
    part = task.partitionId() if task else 0
    return pa.record_batch([pa.array([dims], pa.int32()), pa.array([part], pa.int32()), pa.array([pickle.dumps(sums)], pa.binary())], ["dims", "part", "sums"])


def added(totals: list[dict]) -> dict:
    """Sums of named numbers or arrays, in the order given."""
    out = totals[0]
    for more in totals[1:]:
        out = {k: out[k] + more[k] for k in out}
    return out


def merged(partials: DataFrame) -> dict[int, dict]:
    """The totals of PARTIALS by vector length. Partitions are added in about as many groups as the root of their number, in a fixed
    order; the driver gets one row of each group, whose size does not depend on the rows."""

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("part")["sums"]
        return pd.DataFrame({"dims": [key[0]], "part": [key[1]], "sums": [pickle.dumps(added([pickle.loads(s) for s in ordered]))]})

    groups = max(1, math.isqrt(partials.rdd.getNumPartitions()))
    slot = F.pmod("part", F.lit(groups)).alias("slot")
    found = partials.select("dims", slot, "part", "sums").groupBy("dims", "slot").applyInPandas(add, PARTIALS).collect()
    out: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r["dims"], r["part"])):
        out.setdefault(r["dims"], []).append(pickle.loads(r["sums"]))
    return {d: added(totals) for d, totals in out.items()}
