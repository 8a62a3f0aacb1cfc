"""Aggregates and array functions of the matching and clustering pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_concat(value: Column, delimiter: str, order: Column | None = None) -> Column:
    """Non-null values of a group in order, with the delimiter between; empty values before the first other one leave no delimiter."""
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct((order if order is not None else value).alias("o"), value.alias("v")))))
    step = lambda s, r: F.when(s == "", r["v"]).otherwise(F.concat(s, F.lit(delimiter), r["v"]))
    return F.when(F.size(rows) > 0, F.aggregate(rows, F.lit(""), step))


def hashmin(value: Column) -> Column:
    """The value with the smallest MD5, a sample that any order of rows gives."""
    return F.min_by(value, F.md5(value))


def random_pick(value: Column, seed: str) -> Column:
    """A value of the group, by the smallest MD5 of seed and value."""
    return F.min_by(value, F.md5(F.concat(F.lit(seed), value.cast("string"))))


def top(values: Column, k: int) -> Column:
    """The first k elements."""
    return F.slice(values, 1, k)


def kth(values: Column, k: int) -> Column:
    """The k-th element, or the last of a shorter array; null for an empty one."""
    return F.get(values, F.least(F.lit(k), F.size(values)) - 1)


def cutoff(values: Column, threshold: Column) -> Column:
    """Of ascending weights, the one at which the running sum first reaches the threshold; else the last. Null for a null threshold."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))
    step = lambda s, v: F.when(s["at"].isNotNull(), s).otherwise(F.struct((s["sum"] + v).alias("sum"), F.when(s["sum"] + v >= threshold, v).alias("at")))
    found = F.aggregate(values, start, step)
    return F.when(threshold.isNotNull(), F.coalesce(found["at"], F.get(values, F.size(values) - 1)))


def rank_first(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows of the first rank of each key; ties stay."""
    return rows.withColumn("_rank", F.rank().over(Window.partitionBy(keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def first_rows(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key; k is small, so that Spark's group limit keeps k rows of a key in each task before the shuffle."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(keys).orderBy(*order))).where(F.col("_place") <= k).drop("_place")


def first_by_hash(rows: DataFrame, keys: list[str], k: int, hashed: Column, *ties: Column) -> DataFrame:
    """The k rows of each key with the smallest hashes, with their place among them from 1 on; hashed is hexadecimal (an MD5).

    Rows are counted by the first four digits of their hash, with partial counts in each task; the running sums of these at most
    65,536 counts of a key say which slots are whole, and what place a slot begins with. Only rows of one slot are sorted together, so
    that neither a key nor a sample, whatever its size, meets in one task.
    """
    slotted = rows.withColumns({"_hash": hashed, "_slot": F.substring(hashed, 1, 4)})
    slots = slotted.groupBy(*keys, "_slot").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = slots.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("_slot").alias("_at"), before.alias("_before")).where(F.col("_before") < k)
    same = F.col("_slot") == F.col("_at")
    for i, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy("_hash", *ties))
    found = slotted.join(known, same).withColumn("place", place)
    return found.where(F.col("place") <= k).select(*rows.columns, "place")
