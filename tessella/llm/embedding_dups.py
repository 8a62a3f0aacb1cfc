"""Near-duplicate embeddings by product quantisation: coarse inverted lists, residual subspace codes, exact rerank.

Vectors are brought to unit length in double precision; a cosine of at least 0.98 is a distance of at most
d = sqrt(2 - 2 * 0.98). Equal vectors of a label are one vector with a count.

* Coarse centroids (about the square root of the number of vectors of a label, LISTS at most) and residual codebooks are fitted by
  k-means on a sample of at most SAMPLE vectors for each list and SAMPLE_BYTES in all (the smallest hashes of the ids);
  every vector is indexed.
* Index: a vector goes to the list of its nearest centroid with its code, with the distance e to what its code
  stands for, and with its components in one byte each.
* Search: x is nearer to its centroid c than to any other, so that a y within d of x is at most d beyond the plane between c
  and y's own nearest centroid c'. y probes all lists c with |y - c|^2 - |y - c'|^2 <= 2 d |c - c'|: the probes are
  sufficient, not a guess. Both sides of a list are dealt into blocks, so that no task holds a whole list.
* Asymmetric distances |y - code(x)| come from tables of squared distances for each subspace; x may link only if
  |y - code(x)| <= d + e(x), and only if the one-byte components allow it within their rounding. A first pass finds the vectors
  with a partner; only those are sent at full precision, and reranked by the exact cosine in double precision.

A task returns the number of links of each of its queries and a spanning forest of the links between its vectors, not the
links; components follow from the forests.

Edge cases: null, zero, empty and non-finite vectors, and rows with a null label, link with nothing and are their own
component; vectors of different length do not link; repeated rows with the same vec_id are one vector each for their
links but share the row's component; a null vec_id is its own, null component; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, settle

COSINE = 0.98
SAMPLE, SAMPLE_BYTES, LISTS, SUBSPACES, CODES, ROUNDS = 32, 64 << 20, 4096, 8, 64, 8
BLOCK = 2048


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most k centroids by Lloyd's rounds from random rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = assign(x, centres)[0]
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def assign(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row, and the distances to all centres."""
    square = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
    return square.argmin(1), np.sqrt(np.maximum(square, 0))


class Quantizer:
    """Coarse centroids and residual codebooks of vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        self.coarse = kmeans(sample, lists, 1)
        self.apart = assign(self.coarse, self.coarse)[1]
        rest = sample - self.coarse[assign(sample, self.coarse)[0]]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [kmeans(rest[:, c], CODES, 2 + i) for i, c in enumerate(self.cuts)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, code, error and distances to all centroids of each row."""
        at, far = assign(x, self.coarse)
        rest = x - self.coarse[at]
        code = np.stack([assign(rest[:, c], b)[0] for c, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)
        missing = np.hstack([rest[:, c] - b[code[:, i]] for i, (c, b) in enumerate(zip(self.cuts, self.books, strict=True))])
        return at, code, np.sqrt((missing * missing).sum(1)), far

    def probes(self, far: np.ndarray, reach: float) -> np.ndarray:
        """Which lists (columns) can hold a vector within reach of each row, by its distances to all centroids."""
        near, square = far.argmin(1), far * far
        return square - square.min(1)[:, None] <= 2 * reach * self.apart[near] + 1e-9

    def distances(self, y: np.ndarray, at: int, code: np.ndarray) -> np.ndarray:
        """Squared asymmetric distances of queries (rows) to the codes of list ``at`` (columns), by table lookup."""
        rest, out = y - self.coarse[at], np.zeros((len(y), len(code)))
        for i, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = rest[:, c]
            table = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)
            out += table[:, code[:, i]]
        return out


def _unit(column) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _short(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components in one byte each, and the scale of each row."""
    scale = np.maximum(np.abs(unit).max(1), 1e-300) / 127
    return np.rint(unit / scale[:, None]).astype(np.int8), scale


def _index(quantizers, reach: float):
    """Each vector once for its list (side 0) and once for each list that it probes (side 1)."""
    names = ["label", "dims", "list", "side", "gid", "short", "scale", "code", "error"]

    def run(parts):
        known = quantizers.value
        for part in parts:
            dims = part.column(1).to_numpy()
            for d in np.unique(dims):
                rows = part.filter(pa.array(dims == d))
                for low in range(0, rows.num_rows, 512):
                    piece = rows.slice(low, 512)
                    unit = _unit(piece.column(3))
                    at, code, error, far = known[int(d)].encode(unit)
                    short, scale = _short(unit)
                    who, where = np.nonzero(known[int(d)].probes(far, reach))
                    pick = np.concatenate([np.arange(len(unit)), who])
                    lists, side = np.concatenate([at, where]), np.repeat(np.array([0, 1]), [len(unit), len(who)])
                    full = piece.take(pa.array(pick))
                    yield pa.record_batch(
                        [full.column(0), full.column(1), pa.array(lists.astype(np.int32)), pa.array(side.astype(np.int32)), full.column(2), pa.array([r.tobytes() for r in short[pick]], pa.binary()), pa.array(scale[pick]), pa.array([r.tobytes() if s == 0 else b"" for r, s in zip(code[pick], side, strict=True)], pa.binary()), pa.array(error[pick])],
                        names,
                    )

    return run


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links connect: each query to its first partner, and partners that share a query."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for i in np.flatnonzero(links.any(1)):
        a = int(left[i])
        for j in np.flatnonzero(links[i]):
            b = int(right[j])
            if root(a) != root(b):
                parent[root(a)] = root(b)
                out.append((min(a, b), max(a, b)))
    return out


def _candidates(q: Quantizer, at: int, reach: float, probes: pd.DataFrame, rows: pd.DataFrame):
    """(low, may): for runs of the probes from low on, which rows may be within reach of each."""

    def short(side: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        scale = side["scale"].to_numpy()
        x = np.stack([np.frombuffer(c, np.int8) for c in side["short"]]) * scale[:, None]
        return x.astype(np.float64), scale * (0.5 * math.sqrt(x.shape[1]))

    x, off_x = short(rows)
    code, error = np.stack([np.frombuffer(c, np.uint8) for c in rows["code"]]), rows["error"].to_numpy()
    square = (x * x).sum(1)
    for low in range(0, len(probes), 512):
        y, off_y = short(probes.iloc[low : low + 512])
        may = q.distances(y, at, code) <= (reach + error + off_y[:, None] + 1e-6) ** 2
        far = np.maximum((y * y).sum(1)[:, None] + square - 2 * y @ x.T, 0)
        may &= far <= (reach + off_y[:, None] + off_x + 1e-6) ** 2
        may &= probes["gid"].to_numpy()[low : low + 512, None] != rows["gid"].to_numpy()
        yield low, may


def _partners(quantizers, reach: float):
    """(list, gid) of the vectors on either side that may link to some other."""

    def run(key: tuple, probes: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: set[int] = set()
        if len(probes) and len(rows):
            left, right = probes["gid"].to_numpy(), rows["gid"].to_numpy()
            for low, may in _candidates(quantizers.value[int(key[1])], int(key[2]), reach, probes, rows):
                out |= set(left[low : low + 512][may.any(1)].tolist()) | set(right[may.any(0)].tolist())
        return pd.DataFrame({"list": np.full(len(out), int(key[2]) if len(probes) and len(rows) else 0), "gid": sorted(out)}).astype({"list": "int32", "gid": "int64"})

    return run


def _link(quantizers, cosine: float, reach: float):
    """(gid, n) with the links of a probe, or (a, b) of a forest of the links."""

    def run(key: tuple, probes: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(probes) and len(rows):
            x, count, rep = np.stack([np.frombuffer(u) for u in rows["unit"]]), rows["n"].to_numpy(), rows["rep"].to_numpy()
            gids, reps = probes["gid"].to_numpy(), probes["rep"].to_numpy()
            for low, may in _candidates(quantizers.value[int(key[1])], int(key[2]), reach, probes, rows):
                y = np.stack([np.frombuffer(u) for u in probes["unit"].iloc[low : low + 512]])
                who, whom = np.nonzero(may)
                links = np.zeros_like(may)
                for i in range(0, len(who), 65_536):
                    a, b = who[i : i + 65_536], whom[i : i + 65_536]
                    links[a, b] = np.einsum("ij,ij->i", y[a], x[b]) >= cosine
                n = links @ count
                out += [(int(gids[low + i]), int(n[i]), None, None) for i in np.flatnonzero(n)]
                out += [(None, None, a, b) for a, b in _forest(links, reps[low : low + 512], rep)]
        return pd.DataFrame(out, columns=["gid", "n", "a", "b"]).astype("Int64")

    return run


def _full(parts):
    for part in parts:
        dims = part.column(1).to_numpy()
        for d in np.unique(dims):
            rows = part.filter(pa.array(dims == d))
            yield pa.record_batch([*rows.columns[2:5], pa.array([r.tobytes() for r in _unit(rows.column(5))], pa.binary())], ["gid", "rep", "n", "unit"])


def _fit(rows: DataFrame) -> dict[int, Quantizer]:
    """A quantizer for each vector length, from a bounded sample of each: the ids with the smallest hashes."""
    out = {}
    by_label = rows.groupBy("dims", "label").agg(F.count("*").alias("n"))
    # What a vector meets of its own label, on the average.
    for r in by_label.groupBy("dims").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).cast("long").alias("n")).collect():
        lists = min(LISTS, max(16, math.isqrt(r["n"])))
        size = min(max(8192, SAMPLE * lists), max(1024, SAMPLE_BYTES // (8 * r["dims"])))
        sample = rows.where(F.col("dims") == r["dims"]).orderBy(F.xxhash64("rep"), "rep").limit(size).select("x").toArrow()
        out[r["dims"]] = Quantizer(_unit(sample.column(0).combine_chunks()), lists)
    return out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept."""
    spark, reach = vectors.sparkSession, math.sqrt(2 - 2 * cosine)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("string").alias("label"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    able = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fine)
    groups = able.groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).select("label", F.size("x").alias("dims"), F.monotonically_increasing_id().alias("gid"), "rep", "n", "x")
    groups = settle(groups, "groups")
    quantizers = spark.sparkContext.broadcast(_fit(groups))
    schema = "label string, dims int, list int, side int, gid long, short binary, scale double, code binary, error double"
    placed = settle(groups.select("label", "dims", "gid", "x").mapInArrow(_index(quantizers, reach), schema), "index")
    keys = ["label", "dims", "list", "block", "probe"]

    def cogroup(rows: DataFrame, run, out: str) -> DataFrame:
        sizes = rows.groupBy("label", "dims", "list").agg(*[F.ceil(F.sum((F.col("side") == s).cast("int")) / BLOCK).cast("int").alias(f"blocks{s}") for s in (0, 1)])
        dealt, cols = rows.join(sizes.where("blocks0 > 0 and blocks1 > 0"), ["label", "dims", "list"]), [*keys, *(c for c in rows.columns if c not in (*keys, "side"))]

        def blocks(mine: int, own: str, spread: str) -> DataFrame:
            part = dealt.where(f"side = {mine}").withColumn(own, F.pmod(F.xxhash64("gid"), F.col(f"blocks{mine}")).cast("int"))
            return part.withColumn(spread, F.explode(F.sequence(F.lit(0), F.col(f"blocks{1 - mine}") - 1))).select(cols).toDF(*cols)

        return blocks(1, "probe", "block").groupBy(keys).cogroup(blocks(0, "block", "probe").groupBy(keys)).applyInPandas(run, out)

    met = settle(cogroup(placed, _partners(quantizers, reach), "list int, gid long").distinct(), "met")
    full = groups.join(met.select("gid").distinct(), "gid", "left_semi").select("label", "dims", "gid", "rep", "n", "x").mapInArrow(_full, "gid long, rep long, n long, unit binary")
    wide = settle(placed.join(met, ["list", "gid"], "left_semi").join(full, "gid"), "wide")
    found = settle(cogroup(wide, _link(quantizers, cosine, reach), "gid long, n long, a long, b long"), "links")
    discard(placed, met, wide)
    counts = found.where("gid is not null").groupBy("gid").agg(F.sum("n").alias("near"))
    parts = connected_components(found.where("gid is null").select("a", "b")).toDF("rep", "component")
    known = groups.select("label", "x", "gid", "rep", "n").join(counts, "gid", "left").join(parts, "rep", "left")
    known = known.select("label", "x", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    fit = F.when(F.col("x").isNotNull() & fine, F.col("x"))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("label")).alias("label"), fit.alias("x")).join(known, ["label", "x"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
