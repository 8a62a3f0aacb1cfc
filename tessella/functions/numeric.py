"""Numeric functions: safe casts, Welch's t-test, histograms, colours."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: What counts as a number; Spark alone would also take 1d or 12f.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_num(text: Column) -> Column:
    """The text as a double, null if it is no number."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Rounded half away from zero."""
    return F.round(x, digits)


def weight_formula(matching: Column, other: Column) -> Column:
    """Ratio of two averages, null where it has none."""
    return F.try_divide(matching, other)


def color(x: Column) -> Column:
    """A score of 0 to 1 as two hexadecimal digits."""
    return F.lpad(F.lower(F.hex(F.floor(F.lit(255) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).cast("int"))), 2, "0")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in x.ravel()]).reshape(x.shape)


def incomplete_beta(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function of arrays, by a continued fraction evaluated with Lentz's method."""
    a, b, x = np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, np.float64)) for v in (a, b, x)))
    turn = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    inside = (x > 0) & (x < 1)
    x = np.where(inside, x, 0.5)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    # The fraction 1 / (1 + d1 / (1 + d2 / ...)), with each level kept away from zero.
    away = lambda v: np.where(v == 0, 1e-300, v)
    upper, lower, value = np.ones_like(x), np.zeros_like(x), np.ones_like(x)
    for step in range(1, 800):
        m = step // 2
        term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) if step % 2 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        lower = 1 / away(1 + term * lower)
        upper = away(1 + term / upper)
        value = value * upper * lower
        if (np.abs(upper * lower - 1) < 1e-15).all():
            break
    out = np.where(inside, front / value, 0.0)
    return np.where(turn, 1 - out, out)


def welch(n1, n2, m1, m2, v1, v2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(t, df, two-sided p) of Welch's test, over arrays."""
    s1, s2 = v1 / n1, v2 / n2
    t = np.abs(m1 - m2) / np.sqrt(s1 + s2)
    df = (s1 + s2) ** 2 / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1))
    return t, df, incomplete_beta(df / 2, 0.5, df / (df + t * t))


#: Results for too few values, no variance, overflow; callers keep results below 1 only.
TOO_FEW, NO_VARIANCE, OVERFLOW = 2.0, 3.0, 4.0


def t_test_values(n1, n2, m1, m2, v1, v2) -> np.ndarray:
    """One less the two-sided p-value, or a sentinel of at least 2, over arrays."""
    n1, n2, m1, m2, v1, v2 = (np.atleast_1d(np.asarray(x, np.float64)) for x in (n1, n2, m1, m2, v1, v2))
    few, flat = (n1 < 2) | (n2 < 2), (v1 <= 0) | (v2 <= 0)
    bad = few | flat
    with np.errstate(all="ignore"):
        out = 1 - welch(np.where(bad, 2, n1), np.where(bad, 2, n2), m1, m2, np.where(bad, 1, v1), np.where(bad, 1, v2))[2]
    return np.where(few, TOO_FEW, np.where(flat, NO_VARIANCE, np.where(np.isfinite(out), out, OVERFLOW)))


@F.pandas_udf(DoubleType())
def t_test(n1: pd.Series, n2: pd.Series, m1: pd.Series, m2: pd.Series, v1: pd.Series, v2: pd.Series) -> pd.Series:
    """t_test_values over columns."""
    return pd.Series(t_test_values(n1, n2, m1, m2, v1, v2), dtype="float64")


def histogram(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, bucket, low, high, n): a histogram of the numbers of each key.

    ceil(sqrt(count)) buckets over the range, clipped to the mean and three population standard deviations; bucket -1
    holds what is below and bucket n what is at or above the end, but the maximum of an unclipped range belongs to the last
    bucket. Keys with fewer than two numbers or a constant give no rows.
    """
    x = F.col(value)
    stats = values.groupBy(keys).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"))
    stats = stats.where("count > 1 and high > low").withColumns({"from": F.greatest("low", F.col("mean") - 3 * F.col("sd")), "to": F.least("high", F.col("mean") + 3 * F.col("sd")), "buckets": F.ceil(F.sqrt("count")).cast("int")})
    stats = stats.withColumn("width", (F.col("to") - F.col("from")) / F.col("buckets")).select(*keys, "from", "to", "buckets", "width", "high")
    rows = values.where(x.isNotNull()).join(stats, keys)
    bucket = F.when(x < F.col("from"), -1).when((x == F.col("high")) & (F.col("to") == F.col("high")), F.col("buckets") - 1).when(x >= F.col("to"), F.col("buckets")).otherwise(F.least(F.floor((x - F.col("from")) / F.col("width")), F.col("buckets") - 1))
    return rows.groupBy(*keys, bucket.cast("long").alias("bucket"), "from", "width").agg(F.count("*").alias("n")).select(*keys, "bucket", (F.col("from") + F.col("bucket") * F.col("width")).alias("low"), (F.col("from") + (F.col("bucket") + 1) * F.col("width")).alias("high"), "n")
