"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of the whole text are standardised and mapped to cosines of random projections, whose inner products
approximate a Gaussian kernel. Each partition of the labelled rows sums its part of the normal equations; the sums
(their number is fixed by FEATURES) are solved on the driver. Scores of labelled rows that the ridge fit did not see
are counted in a fixed grid of bins and made monotone by pooling adjacent violators.

Which rows are held out is decided by crc32 of the doc_id as text: remainder 2 of 4 is never learned from, remainder 3
calibrates, 0 and 1 fit. Labels, lang, source and doc_id are not inputs of a score.

Edge cases: null texts count as empty; empty texts get a score like all others; repeated labels count repeatedly; null
labels and labels of unknown doc_ids are left out; without any label of either class every score is 0.5; a null doc_id is
not held out and its score is that of its text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, batches, settle

#: Random Fourier features, the kernel's width in standard deviations, the ridge penalty for each row, calibration bins.
FEATURES, WIDTH, RIDGE, GRID = 192, 3.0, 1e-4, 2048
THRESHOLD = 0.7
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STATISTICS = 22


def statistics(texts: list[str], hasher: WordHasher) -> np.ndarray:
    """STATISTICS numbers for each text; scale free but for the logarithms of length."""
    hashes, at = hasher(texts)
    out = np.zeros((len(texts), STATISTICS))
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "replace")
        n = max(1, len(raw))
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words = hashes[at[i] : at[i + 1]]
        w = max(1, len(words))
        distinct, times = np.unique(words, return_counts=True)
        lines = text.split("\n")
        marks = counts[list(_MARKS)]
        share = counts[counts > 0] / n
        upper, lower = counts[65:91].sum(), counts[97:123].sum()
        repeats = float((words[1:] == words[:-1]).sum()) if len(words) > 1 else 0.0
        pairs = words[1:] ^ (words[:-1] << np.uint64(1)) if len(words) > 1 else words[:0]
        out[i] = (
            np.log1p(len(raw)), np.log1p(len(words)), len(text) / w / 10, upper / n, lower / n, counts[48:58].sum() / n, counts[128:].sum() / n, marks.sum() / n,
            (counts[46] + counts[44]) / w, counts[33] / w, counts[124] / w, (counts[35] + counts[36] + counts[37] + counts[38] + counts[42]) / w, counts[[32, 9, 10, 13]].sum() / n,
            len(distinct) / w, times.max(initial=0) / w, repeats / w, len(np.unique(pairs)) / w, len(set(lines)) / len(lines), np.log1p(len(lines)), np.log1p(len(text) / len(lines)),
            -(share * np.log(share)).sum(), (times.astype(float) ** 2).sum() / w / w,
        )
    return out


def _describe(parts):
    hasher = WordHasher()
    for part in parts:
        texts = [t or "" for t in part.column(1).to_pylist()]
        for a, b in batches(texts):
            found = statistics(texts[a:b], hasher).astype(np.float32)
            yield pa.record_batch([part.column(0).slice(a, b - a), pa.array(list(found), pa.list_(pa.float32()))], ["doc_id", "statistics"])


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics) of each whole text."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_describe, "doc_id long, statistics array<float>")


class Map:
    """Standardisation and random Fourier features, a function of the moments and a seed."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, seed: int = 20) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.frequency = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.frequency + self.phase), np.ones((len(x), 1))])


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), STATISTICS).astype(np.float64)


def _sums(features: Map):
    """Upper triangle of a partition's Z'Z and Z'y, as rows (cell, value)."""

    def run(parts):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for part in parts:
            for low in range(0, part.num_rows, 4096):
                piece = part.slice(low, 4096)
                z = features(_matrix(piece.column(0)))
                total += z.T @ np.hstack([z, piece.column(1).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]])
        cells = np.flatnonzero(np.triu(np.ones_like(total, bool)) & (total != 0))
        yield pa.record_batch([pa.array(cells), pa.array(total.ravel()[cells])], ["cell", "value"])

    return run


def isotonic(n: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Non-decreasing fit of good / n by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for size, total in zip(n, good, strict=True):
        blocks.append([float(size), float(total), 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    return np.repeat([t / s for s, t, _ in blocks], [int(k) for _, _, k in blocks])


class Model:
    """Scores of statistics: ridge weights on Fourier features, then the calibration curve."""

    def __init__(self, features: Map, weights: np.ndarray, knots: np.ndarray, values: np.ndarray) -> None:
        self.features, self.weights, self.knots, self.values = features, weights, knots, values

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -1, 2)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        # A small share of the raw score keeps the order within the flat parts of the curve.
        raw = self.raw(x)
        return np.clip(0.99 * np.interp(raw, self.knots, self.values) + 0.01 * (raw + 1) / 3, 0, 1)


def _bins(model: Model):
    def run(parts):
        n, good = np.zeros(GRID, np.int64), np.zeros(GRID, np.int64)
        for part in parts:
            at = np.minimum(((model.raw(_matrix(part.column(0))) + 1) / 3 * GRID).astype(np.int64), GRID - 1)
            np.add.at(n, at, 1)
            np.add.at(good, at, part.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
        used = np.flatnonzero(n)
        yield pa.record_batch([pa.array(used), pa.array(n[used]), pa.array(good[used])], ["bin", "n", "good"])

    return run


def fold(column: str = "doc_id"):
    """crc32 of the doc_id as text, modulo 4; 2 is held out."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(4))


def fit(described: DataFrame, labels: DataFrame) -> Model:
    """The model of labels (doc_id, quality) over described documents; only folds 0, 1 (fit) and 3 (calibration) are read."""
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    rows = settle(described.join(known.withColumn("fold", fold()).where("fold <> 2"), "doc_id").select("statistics", "quality", "fold"), "labelled")
    seen = rows.where("fold <> 3")
    moments = seen.select([f(F.element_at("statistics", i + 1).cast("double")).alias(f"{k}{i}") for i in range(STATISTICS) for k, f in (("m", F.avg), ("d", F.stddev_pop))] + [F.min("quality").alias("low"), F.max("quality").alias("high")]).first()
    none = Map(np.zeros(STATISTICS), np.ones(STATISTICS))
    if moments["low"] is None or moments["low"] == moments["high"]:
        return Model(none, np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    features = Map(np.array([moments[f"m{i}"] for i in range(STATISTICS)]), np.array([moments[f"d{i}"] for i in range(STATISTICS)]))
    cells = seen.select("statistics", "quality").mapInArrow(_sums(features), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros((FEATURES + 1, FEATURES + 2))
    total.ravel()[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    square = np.triu(total[:, :-1]) + np.triu(total[:, :-1], 1).T
    weights = np.linalg.solve(square + RIDGE * square[-1, -1] * np.eye(FEATURES + 1), total[:, -1])
    model = Model(features, weights, np.zeros(0), np.zeros(0))
    found = rows.where("fold = 3").select("statistics", "quality").mapInArrow(_bins(model), "bin long, n long, good long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("bin").toPandas()
    if len(found):
        knots, values = (found["bin"].to_numpy() + 0.5) / GRID * 3 - 1, isotonic(found["n"].to_numpy(), found["good"].to_numpy())
    else:
        knots, values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return Model(features, weights, knots, values)


def _score(model):
    def run(parts):
        for part in parts:
            yield pa.record_batch([part.column(0), pa.array(model.value(_matrix(part.column(1))))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on)."""
    described = settle(describe(docs), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(fit(described, labels))
    scored = described.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier predicts to be good, with all columns.

    The whole text's statistics are computed for the model and again where the score decides; only statistics are
    written, and texts are not shuffled.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(settle(describe(docs), "statistics"), labels))

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        hasher, out = WordHasher(), []
        whole = [t or "" for t in texts]
        for a, b in batches(whole):
            out += list(model.value(statistics(whole[a:b], hasher).astype(np.float32).astype(float)) >= THRESHOLD)
        return pd.Series(out, dtype=bool)

    return docs.where(good(F.col("text").cast("string")))
