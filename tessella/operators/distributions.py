"""Matcher 4: Welch's t-test of numeric fields against mapped ones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import t_test, to_num


def sums(cells: DataFrame) -> DataFrame:
    """(field_id, n, sum_x, sum_xx) over the cells that are numbers."""
    x = to_num(F.col("value"))
    return cells.select("field_id", x.alias("x")).where("x is not null").groupBy("field_id").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"), F.sum(F.col("x") * F.col("x")).alias("sum_xx"))


def moments(cells: DataFrame) -> DataFrame:
    """(field_id, n, mean, variance) of fields with two numbers or more; sample variance, fields without a finite one dropped."""
    x = to_num(F.col("value"))
    rows = cells.select("field_id", x.alias("x")).where("x is not null")
    stats = rows.groupBy("field_id").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance"))
    return stats.where("n > 1 and not isnan(variance) and abs(variance) < double('Infinity')")


def global_moments(stats: DataFrame, affinity: DataFrame) -> DataFrame:
    """(global_id, field_id, n, mean, variance, affinity): one row for each mapped field, not pooled."""
    return stats.join(affinity, F.col("field_id") == F.col("local_id")).select("global_id", "field_id", "n", "mean", "variance", "affinity")


def comparisons(stats: DataFrame, glob: DataFrame) -> DataFrame:
    """(field_id, global_id, affinity, p): every field against every mapped field by a theta join.

    Both sides have one row for each field or mapping, never one for each cell, and every pair is a result; ``comparisons_above`` forms
    only those that can reach a score.
    Sentinels of the test (2 and more) are dropped.
    """
    right = glob.select("global_id", F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("variance").alias("v2"), "affinity")
    both = stats.crossJoin(right)
    p = t_test(F.col("n").cast("double"), F.col("n2").cast("double"), "mean", "m2", "variance", "v2")
    return both.select("field_id", "global_id", "affinity", p.alias("p")).where("p < 1")


def scores_of(stats: DataFrame, glob: DataFrame) -> DataFrame:
    """(field_id, global_id, score): the largest two-sided p-value times affinity."""
    return comparisons(stats, glob).groupBy("field_id", "global_id").agg(F.max((1 - F.col("p")) * F.col("affinity")).alias("score"))


#: Upper bounds on the two-sided p-value are held against the floor with this much to spare, for rounding.
SPARE = 1e-6


def near_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of rows whose intervals [low, high] meet, each once; columns of both sides, prefixed l_ and r_.

    An interval has the level of the power of two that covers its length, and lies in one to three cells of that size. The finer interval of
    a pair is lifted to the levels that the other side has (some 2,000 at most, one for each exponent), and both meet in the cell that
    holds the larger of their lower ends. So rows meet by equal keys, whatever the scales of their values.
    """
    level = F.ceil(F.log2(F.greatest(F.col("high") - F.col("low"), F.lit(1e-300)))).cast("int")

    def side(rows: DataFrame, mark: str) -> DataFrame:
        return rows.withColumn("level", level).select([F.col(c).alias(f"{mark}_{c}") for c in (*rows.columns, "level")])

    def cell(x: str, at: Column) -> Column:
        # Adding zero makes the negative zero a positive one, so that a cell has one name.
        return F.rint(F.col(x) / F.pow(F.lit(2.0), at)) + F.lit(0.0)

    def in_cells(rows: DataFrame, mark: str) -> DataFrame:
        first, last = cell(f"{mark}_low", F.col("at")), cell(f"{mark}_high", F.col("at"))
        return rows.withColumn("cell", F.explode(F.array_distinct(F.array(first, F.least(first + 1, last), last))))

    def lifted(rows: DataFrame, mark: str, other: DataFrame, above: int) -> DataFrame:
        levels = other.select(F.col(f"{'r' if mark == 'l' else 'l'}_level").alias("at")).distinct()
        return in_cells(rows.join(F.broadcast(levels), F.col("at") >= F.col(f"{mark}_level") + above), mark)

    l, r = side(left, "l"), side(right, "r")  # noqa: E741
    finer_left = lifted(l, "l", r, 0).join(in_cells(r.withColumn("at", F.col("r_level")), "r"), ["at", "cell"])
    finer_right = lifted(r, "r", l, 1).join(in_cells(l.withColumn("at", F.col("l_level")), "l"), ["at", "cell"])
    met = finer_left.unionByName(finer_right).where("greatest(l_low, r_low) <= least(l_high, r_high)").withColumn("_from", F.greatest("l_low", "r_low"))
    return met.where(cell("_from", F.col("at")) == F.col("cell")).drop("_from", "at", "cell", "l_level", "r_level")


def comparisons_above(stats: DataFrame, glob: DataFrame, floor: float) -> DataFrame:
    """(field_id, global_id, affinity, p) as ``comparisons``, of all pairs with (1 - p) * affinity >= floor and of few others; floor > 0.

    At least floor / affinity of the two-sided p-value is needed, and with one degree of freedom or more it is at most 2 / pi * atan(1 / t): so t
    is bounded, and means lie within so many of both standard errors. Pairs of such intervals alone are formed. Before the test they must
    also pass the bound of their own affinity, and Chebyshev's, df / ((df - 2) * t^2), which is sharper for large df and t.
    """
    if floor <= 0:
        raise ValueError("floor must be positive: without one every pair is a result")
    if floor > 1:
        return comparisons(stats.limit(0), glob)
    reach = F.lit(1 / math.tan(math.pi / 2 * floor * (1 - SPARE)) * (1 + SPARE)) * F.sqrt(F.col("variance") / F.col("n"))

    def ends(rows: DataFrame) -> DataFrame:
        return rows.where("variance > 0").withColumns({"low": F.col("mean") - reach, "high": F.col("mean") + reach})

    right = glob.where(F.col("affinity") >= floor).select("global_id", "affinity", "n", "mean", "variance")
    pairs = near_pairs(ends(stats.select("field_id", "n", "mean", "variance")), ends(right))
    pairs = pairs.withColumns({"s1": F.col("l_variance") / F.col("l_n"), "s2": F.col("r_variance") / F.col("r_n"), "d": F.abs(F.col("l_mean") - F.col("r_mean"))})
    pairs = pairs.withColumns({"tt": F.col("d") * F.col("d") / (F.col("s1") + F.col("s2")), "df": F.pow(F.col("s1") + F.col("s2"), 2) / (F.col("s1") * F.col("s1") / (F.col("l_n") - 1) + F.col("s2") * F.col("s2") / (F.col("r_n") - 1))})
    cauchy = 2 / math.pi * F.atan2(F.lit(1.0), F.sqrt("tt"))
    # A value without a bound by Chebyshev, or one that overflows, is tested.
    chebyshev = F.when((F.col("df") > 2) & (F.col("tt") > 0), F.col("df") / ((F.col("df") - 2) * F.col("tt"))).otherwise(1.0)
    bound = F.least(cauchy, F.when(F.isnan(chebyshev), 1.0).otherwise(chebyshev))
    kept = pairs.where(F.coalesce(bound * F.col("r_affinity") >= floor * (1 - SPARE), F.lit(True)))
    p = t_test(F.col("l_n").cast("double"), F.col("r_n").cast("double"), "l_mean", "r_mean", "l_variance", "r_variance")
    return kept.select(F.col("l_field_id").alias("field_id"), F.col("r_global_id").alias("global_id"), F.col("r_affinity").alias("affinity"), p.alias("p")).where("p < 1")


def scores_above(stats: DataFrame, glob: DataFrame, floor: float) -> DataFrame:
    """(field_id, global_id, score) of ``scores_of`` with score >= floor, without forming pairs that cannot reach it."""
    rows = comparisons_above(stats, glob, floor).groupBy("field_id", "global_id").agg(F.max((1 - F.col("p")) * F.col("affinity")).alias("score"))
    return rows.where(F.col("score") >= floor)


def scores(cells: DataFrame, affinity: DataFrame) -> DataFrame:
    stats = moments(cells)
    return scores_of(stats, global_moments(stats, affinity))


def welch(stats: DataFrame, glob: DataFrame) -> DataFrame:
    """(field_id, global_id, mapped, t, df) of the test, for fields that vary."""
    right = glob.select("global_id", F.col("field_id").alias("mapped"), F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("variance").alias("v2"))
    q = stats.crossJoin(right).where("variance > 0 and v2 > 0").withColumns({"s1": F.col("variance") / F.col("n"), "s2": F.col("v2") / F.col("n2")})
    t = F.abs(F.col("mean") - F.col("m2")) / F.sqrt(F.col("s1") + F.col("s2"))
    df = F.pow(F.col("s1") + F.col("s2"), 2) / (F.col("s1") * F.col("s1") / (F.col("n") - 1) + F.col("s2") * F.col("s2") / (F.col("n2") - 1))
    return q.select("field_id", "global_id", "mapped", t.alias("t"), df.alias("df"))
