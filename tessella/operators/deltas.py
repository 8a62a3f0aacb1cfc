"""Global models kept up by signed differences: counts form a group, so that what changed is added and what it replaced is taken away.

An attribute's counts are sums over mapped fields of count times affinity. A changed mapping changes a field's affinity, and a source that is
imported anew changes its fields' counts; either gives differences for the keys (global_id, gram) concerned only. Differences
are added to the counts by key; with counts as decimals they cancel exactly, so that keys nothing holds any more vanish.
Document frequencies and totals follow from keys that appear, vanish or change.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counts times affinities, exact to twelve places.
EXACT = "decimal(38,12)"


def _product(count: str, affinity: Column) -> Column:
    return (F.col(count).cast("decimal(20,0)") * affinity.cast("decimal(14,12)")).cast(EXACT)


def contributions(local: DataFrame, affinity: DataFrame) -> DataFrame:
    """(global_id, gram, d): what mapped fields add; local (field_id, gram, c), affinity (local_id, global_id, affinity)."""
    rows = local.join(affinity, F.col("field_id") == F.col("local_id"))
    return _summed(rows.select("global_id", "gram", _product("c", F.col("affinity")).alias("d")))


def _summed(*parts: DataFrame) -> DataFrame:
    """Differences added by key; those that cancel are gone."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("global_id", "gram").agg(F.sum("d").cast(EXACT).alias("d")).where("d <> 0")


def of_mappings(local: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(global_id, gram, d) of changed affinities: only fields whose affinity to an attribute changed are read."""
    old, new = before.select("local_id", "global_id", F.col("affinity").alias("old")), after.select("local_id", "global_id", F.col("affinity").alias("new"))
    zero = F.lit(0.0)
    changed = old.join(new, ["local_id", "global_id"], "full").select("local_id", "global_id", F.coalesce("old", zero).alias("old"), F.coalesce("new", zero).alias("new")).where("old <> new")
    rows = local.join(changed, F.col("field_id") == F.col("local_id"))
    return _summed(rows.select("global_id", "gram", (_product("c", F.col("new")) - _product("c", F.col("old"))).cast(EXACT).alias("d")))


def of_source(before: DataFrame, after: DataFrame, affinity: DataFrame) -> DataFrame:
    """(global_id, gram, d) of a source's local counts (field_id, gram, c) that were replaced."""
    taken = before.select("field_id", "gram", (-F.col("c")).alias("c"))
    net = after.select("field_id", "gram", "c").unionByName(taken).groupBy("field_id", "gram").agg(F.sum("c").alias("c")).where("c <> 0")
    return contributions(net, affinity)


def applied(counts: DataFrame, delta: DataFrame) -> DataFrame:
    """(global_id, gram, d) after a difference; what is zero afterwards is gone."""
    return _summed(counts, delta)


def touched(counts: DataFrame, delta: DataFrame) -> DataFrame:
    """(global_id, gram, before, after) of the keys of a difference; before and after are 0 where the key is absent."""
    zero = F.lit(0).cast(EXACT)
    old = counts.withColumnRenamed("d", "before").join(delta.select("global_id", "gram"), ["global_id", "gram"], "left_semi")
    rows = delta.join(old, ["global_id", "gram"], "left")
    return rows.select("global_id", "gram", F.coalesce("before", zero).alias("before"), (F.coalesce("before", zero) + F.col("d")).cast(EXACT).alias("after"))


def frequencies(df: DataFrame, changes: DataFrame) -> DataFrame:
    """(gram, df) after changes: a gram gains an attribute where a key appears and loses one where it vanishes."""
    step = F.when((F.col("before") == 0) & (F.col("after") != 0), 1).when((F.col("before") != 0) & (F.col("after") == 0), -1).otherwise(0)
    moves = changes.groupBy("gram").agg(F.sum(step).alias("df")).where("df <> 0")
    return df.unionByName(moves.withColumn("df", F.col("df").cast("long"))).groupBy("gram").agg(F.sum("df").alias("df")).where("df > 0")


def totals(sums: DataFrame, delta: DataFrame) -> DataFrame:
    """(global_id, total) after a difference."""
    more = delta.groupBy("global_id").agg(F.sum("d").cast(EXACT).alias("total"))
    return sums.unionByName(more).groupBy("global_id").agg(F.sum("total").cast(EXACT).alias("total")).where("total <> 0")


def square_norms(squares: DataFrame, changes: DataFrame) -> DataFrame:
    """(global_id, squares) after changes: the sum of squared counts moves by after^2 - before^2 of the keys touched."""
    double = lambda c: F.col(c).cast("double")
    more = changes.groupBy("global_id").agg(F.sum(double("after") * double("after") - double("before") * double("before")).alias("squares"))
    return squares.unionByName(more).groupBy("global_id").agg(F.sum("squares").alias("squares"))


class GlobalCounts:
    """counts (global_id, gram, d), df (gram, df), totals (global_id, total) and squares (global_id, squares) of all attributes."""

    def __init__(self, counts: DataFrame) -> None:
        self.counts = counts
        self.df = counts.groupBy("gram").agg(F.count("*").alias("df"))
        self.totals = counts.groupBy("global_id").agg(F.sum("d").cast(EXACT).alias("total"))
        self.squares = counts.groupBy("global_id").agg(F.sum(F.pow(F.col("d").cast("double"), 2)).alias("squares"))

    @classmethod
    def build(cls, local: DataFrame, dictionary: DataFrame, affinity: DataFrame) -> GlobalCounts:
        """From scratch; dictionary (global_id, gram, c) are counts of the attributes' own values."""
        own = dictionary.select("global_id", "gram", F.col("c").cast(EXACT).alias("d"))
        return cls(_summed(contributions(local, affinity), own).checkpoint())

    def update(self, delta: DataFrame) -> GlobalCounts:
        """After a difference: frequencies, totals and squares move by the keys touched; none is counted again."""
        delta = delta.checkpoint()
        changes = touched(self.counts, delta).checkpoint()
        out = object.__new__(GlobalCounts)
        out.counts, out.df = applied(self.counts, delta).checkpoint(), frequencies(self.df, changes)
        out.totals, out.squares = totals(self.totals, delta), square_norms(self.squares, changes)
        return out

    def shares(self) -> DataFrame:
        """(global_id, gram, c, tf) as the token matcher reads them."""
        double = lambda c: F.col(c).cast("double")
        return self.counts.join(self.totals, "global_id").select("global_id", "gram", double("d").alias("c"), (double("d") / double("total")).alias("tf"))
