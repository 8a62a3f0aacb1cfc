"""Whitening of embeddings by a matrix-free block Lanczos iteration.

Components become x = floor(256 * c). The covariance V of the distinct vectors x (divisor n) is never formed: a pass over
the data sends a block Q of a few orthonormal columns to every partition, which returns its part of (X - m)' ((X - m) Q), the
vectors centred before anything is multiplied. Partial sums are merged on executors and the driver keeps
matrices of a vector's length only.

* Each block is orthogonalised twice against the whole basis. Where columns vanish (breakdown: the basis spans an invariant
  subspace in their direction) they are replaced by random directions orthogonal to the basis, and the iteration goes on.
* It ends when the residuals of the wanted Ritz pairs are below TOLERANCE times the largest eigenvalue, or the basis is
  full. A basis of more than BASIS blocks is restarted from its best Ritz vectors, as is one whose residuals, measured by one more
  pass over the data, are above CHECKED.
* The trace of V is the exact integer sum of all (n * x - S)^2, S the sums of x, over n^3; shares are e / trace.
* The whitened fit list's covariance is measured by a pass of its own.

Edge cases: null, empty and non-finite vectors are dropped, other rows are kept, those with a null vec_id or repeated ones too;
vectors of each length have a model of their own, fitted in the same passes; directions without variance (e below 1e-12 of the
largest) cannot be whitened and have no rows, so that a table with fewer than two distinct vectors gives none; an empty table
gives no rows; components beyond 2^62 / 256 in size are clipped; a deviation beyond 64 bits is null; other columns are ignored. Among
equal eigenvalues any orthonormal directions are right. A component's sign makes its largest entry positive.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle
from .integers import PARTIALS, by_length, exact_sums, merged, pack, partial, scaled, unpack, whole_vectors

SCALE, COMPONENTS = 256, 4
BLOCK, BASIS = 8, 64
TOLERANCE, CHECKED, RESTARTS = 1e-14, 1e-11, 20
#: A direction whose variance is a smaller share of the largest has none.
NOTHING = 1e-12
#: Rows whose vectors a task holds as doubles at once.
ROWS = 4096


def orthonormal(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Orthonormal columns that span block beyond basis, and the number of columns that broke down and were replaced at random."""
    room = basis.shape[0] - basis.shape[1]
    out, lost = np.zeros((basis.shape[0], 0)), 0
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    for i in range(min(block.shape[1], room)):
        v, broken = (u[:, i], False) if s[i] > 1e-13 * scale else (rng.standard_normal(len(u)), True)
        while True:
            for _ in range(2):
                v = v - basis @ (basis.T @ v)
                v = v - out @ (out.T @ v)
            size = np.linalg.norm(v)
            if size > 1e-8:
                break
            v, broken = rng.standard_normal(len(u)), True
        lost += broken
        out = np.hstack([out, (v / size)[:, None]])
    return out, lost


class BlockLanczos:
    """The iteration for one vector length: ``block`` is to be multiplied by V, ``tell`` takes the product."""

    def __init__(self, dims: int, wanted: int, width: int = BLOCK, blocks: int = BASIS, seed: int = 11) -> None:
        self.rng, self.dims, self.wanted, self.blocks = np.random.default_rng(seed), dims, min(wanted, dims), blocks
        self.width, self.restarts, self.breakdowns, self.passes = min(max(width, wanted), dims), 0, 0, 0
        self.values, self.vectors, self.done = np.zeros(0), np.zeros((dims, 0)), False
        self.start(self.rng.standard_normal((dims, self.width)))

    def start(self, block: np.ndarray) -> None:
        self.basis, self.products = np.zeros((self.dims, 0)), np.zeros((self.dims, 0))
        self.block = orthonormal(block, self.basis, float(np.abs(block).max()), self.rng)[0]

    def tell(self, product: np.ndarray) -> None:
        """Extends the basis by the block whose product with V this is; chooses the next block or ends."""
        self.passes += 1
        self.basis, self.products = np.hstack([self.basis, self.block]), np.hstack([self.products, product])
        inner = self.basis.T @ self.products
        values, within = np.linalg.eigh((inner + inner.T) / 2)
        values, within = values[::-1], within[:, ::-1]
        top, full = max(abs(values[0]), 1e-300), self.basis.shape[1] == self.dims
        rest = product
        for _ in range(2):
            rest = rest - self.basis @ (self.basis.T @ rest)
        residual = np.linalg.norm(rest @ within[-self.block.shape[1] :, : self.wanted], axis=0)
        self.values, self.vectors = values[: self.wanted], self.basis @ within[:, : self.wanted]
        if full or (len(self.values) == self.wanted and (residual <= TOLERANCE * top).all()):
            self.done = True
            return
        if self.basis.shape[1] >= self.blocks * self.width:
            self.restart(self.basis @ within[:, : self.width])
            return
        self.block, lost = orthonormal(rest, self.basis, top, self.rng)
        self.breakdowns += lost > 0

    def restart(self, block: np.ndarray) -> None:
        self.restarts += 1
        if self.restarts > RESTARTS:
            raise RuntimeError("the Lanczos iteration did not converge")
        self.done = False
        self.start(block)


def _pack(parts):
    for part in parts:
        for d, rows in by_length(part):
            yield pa.record_batch([rows.column("dims"), pa.array(pack(scaled(rows.column("embedding"), SCALE)), pa.binary())], ["dims", "x"])


def _pieces(parts):
    for part in parts:
        for d, rows in by_length(part):
            packed = rows.column("x").to_pylist()
            for low in range(0, len(packed), ROWS):
                yield d, unpack(packed[low : low + ROWS], d)


def _sums(measure):
    """A function for mapInArrow that adds up measure(dims, x) over this partition."""

    def run(parts):
        total: dict[int, dict] = {}
        for d, x in _pieces(parts):
            more = measure(d, x)
            if more is not None:
                total[d] = {k: total[d][k] + more[k] for k in more} if d in total else more
        for d, sums in total.items():
            yield partial(d, sums)

    return run


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """sum over dimensions of (n * x - S)^2 for each row, exact: as 64-bit integers where they fit, else as Python integers."""
    bound = n * int(np.abs(x).max(initial=0)) + max(abs(int(v)) for v in sums)
    kind = np.int64 if bound * bound * x.shape[1] < 1 << 63 else object
    apart = x.astype(kind) * n - sums.astype(kind)
    return (apart * apart).sum(1)


class Model:
    """n, sums, mean, and the iteration's result for one vector length."""

    def __init__(self, n: int, sums: np.ndarray) -> None:
        self.n, self.sums = n, sums
        self.mean = np.array([float(Fraction(int(s), n)) for s in sums])
        self.values, self.vectors = np.zeros(0), np.zeros((len(sums), 0))
        self.explained, self.identity_error = np.zeros(0), 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The model of each vector length in vectors, a result of whole_vectors."""
    spark = vectors.sparkSession
    packed = vectors.select(F.size("embedding").alias("dims"), "embedding").mapInArrow(_pack, "dims int, x binary")
    rows = settle(packed.groupBy("dims", "x").agg(F.lit(0).alias("none")).select("dims", "x"), "fit_list")

    def total(measure) -> dict[int, dict]:
        return merged(rows.mapInArrow(_sums(measure), PARTIALS))

    models = {d: Model(s["n"], s["sums"]) for d, s in total(lambda d, x: {"n": len(x), "sums": exact_sums(x)}).items()}
    iterations = {d: BlockLanczos(d, components) for d in models}
    live = dict.fromkeys(models, True)
    trace: dict[int, int] = {}

    def multiply(blocks: dict[int, np.ndarray]) -> dict[int, dict]:
        known = spark.sparkContext.broadcast({d: (models[d].n, models[d].sums, models[d].mean, b, d not in trace) for d, b in blocks.items()})

        def measure(d: int, x: np.ndarray):
            if d not in known.value:
                return None
            n, sums, mean, block, first = known.value[d]
            centred = x - mean
            out: dict[str, object] = {"product": centred.T @ (centred @ block)}
            if first:
                out["trace"] = int(sum(deviations(x, n, sums).tolist()))
            return out

        found = total(measure)
        for d, s in found.items():
            if "trace" in s:
                trace[d] = s["trace"]
        return {d: s["product"] / models[d].n for d, s in found.items()}

    while any(live.values()):
        blocks = {d: it.vectors if it.done else it.block for d, it in iterations.items() if live[d]}
        for d, product in multiply(blocks).items():
            it = iterations[d]
            if not it.done:
                it.tell(product)
                continue
            # One more pass has measured the residuals of the Ritz pairs themselves.
            apart = np.linalg.norm(product - it.vectors * it.values, axis=0)
            if (apart <= CHECKED * max(abs(it.values[0]), 1e-300)).all():
                live[d] = False
                models[d].values, models[d].vectors = (it.vectors * product).sum(0), it.vectors
            else:
                more = it.rng.standard_normal((d, it.width - it.vectors.shape[1]))
                it.restart(np.hstack([it.vectors, more]))
    for d, m in models.items():
        seen = m.values > NOTHING * max(m.values.max(initial=0), 0)
        if trace[d] == 0:
            seen[:] = False
        order = np.argsort(-m.values[seen], kind="stable")
        m.values, m.vectors = m.values[seen][order], m.vectors[:, seen][:, order]
        sign = np.sign(m.vectors[np.abs(m.vectors).argmax(0), np.arange(len(m.values))])
        m.vectors = m.vectors * sign
        m.explained = np.array([float(Fraction(float(e)) / Fraction(trace[d], m.n**3)) for e in m.values])
    sent = spark.sparkContext.broadcast(models)

    def spread(d: int, x: np.ndarray) -> dict[str, object]:
        z = sent.value[d].whiten(x)
        return {"first": z.sum(0), "second": z.T @ z}

    for d, s in total(spread).items():
        mean = s["first"] / models[d].n
        apart = s["second"] / models[d].n - np.outer(mean, mean) - np.eye(len(mean))
        models[d].identity_error = float(np.abs(apart).max(initial=0))
    discard(rows)
    return models


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    whole = whole_vectors(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    known = vectors.sparkSession.sparkContext.broadcast(fit(whole, components))
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(parts):
        for part in parts:
            for d, rows in by_length(part):
                m = known.value[d]
                k = len(m.values)
                for low in range(0, rows.num_rows if k else 0, ROWS):
                    piece = rows.slice(low, ROWS)
                    x = scaled(piece.column("embedding"), SCALE)
                    far, size = deviations(x, m.n, m.sums), len(x)
                    again = np.repeat(np.arange(size), k)
                    far = [v if v < 1 << 63 else None for v in far.tolist()]
                    yield pa.record_batch(
                        [
                            piece.column("vec_id").take(pa.array(again)),
                            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                            pa.array(np.full(size * k, m.n)),
                            pa.array(far, pa.int64()).take(pa.array(again)),
                            pa.array(m.whiten(x).ravel()),
                            pa.array(np.tile(m.explained, size)),
                            pa.array(np.full(size * k, m.identity_error)),
                        ],
                        schema=schema,
                    )

    return whole.select("vec_id", F.size("embedding").alias("dims"), "embedding").mapInArrow(run, OUT)
