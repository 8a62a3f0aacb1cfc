"""Matcher 3: minimum description length of a field's values given an attribute's dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a value that the dictionaries keep.
LONGEST = 1000


def local_dictionary(cells: DataFrame) -> DataFrame:
    """(source_id, field_id, value, c) of values cut to LONGEST characters."""
    return cells.where("value is not null").groupBy("source_id", "field_id", F.substring("value", 1, LONGEST).alias("value")).agg(F.count("*").alias("c"))


def input_stats(local: DataFrame) -> DataFrame:
    """(field_id, n, avglen, maxlen)."""
    size = F.length("value")
    return local.groupBy("field_id").agg(F.sum("c").alias("n"), (F.sum(size * F.col("c")) / F.sum("c")).alias("avglen"), F.max(size).cast("long").alias("maxlen"))


def base_length(stats: DataFrame) -> DataFrame:
    """(field_id, domain, dl): eight bits for each character."""
    return stats.select("field_id", F.lit("STRING").alias("domain"), (8 * F.col("avglen")).alias("dl"))


def global_dictionary(local: DataFrame, training: DataFrame) -> DataFrame:
    """(global_id, value, affinity) with affinity at most 1; training has the affinities that reach the threshold."""
    return local.join(training, F.col("field_id") == F.col("local_id")).groupBy("global_id", "value").agg(F.least(F.lit(1.0), F.sum("affinity")).alias("affinity"))


def cards_by_length(dictionary: DataFrame) -> DataFrame:
    """(global_id, len, card, lg_card) of a dictionary."""
    return dictionary.groupBy("global_id", F.length("value").alias("len")).agg(F.sum("affinity").alias("card")).withColumn("lg_card", F.log2("card"))


def matches(local: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(field_id, global_id, len, card, lg_card): affinity-weighted counts of values in both, by length."""
    both = local.join(dictionary, "value")
    return both.groupBy("field_id", "global_id", F.length("value").alias("len")).agg(F.sum(F.col("c") * F.col("affinity")).alias("card")).withColumn("lg_card", F.log2("card"))


def description_length(local: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(field_id, global_id, n, avglen, maxlen, f, term1, term2, term3).

    Matched lengths meet dictionary lengths of the attribute each with each; both sides are summed first, which gives
    the same sums without the product of rows.
    """
    found = matches(local, dictionary).groupBy("field_id", "global_id").agg(F.avg("card").alias("card"), F.count("*").alias("i"), F.sum("lg_card").alias("lg_i"))
    cards = cards_by_length(dictionary).groupBy("global_id").agg(F.count("*").alias("l"), F.sum("lg_card").alias("lg_l"))
    full = found.join(cards, "global_id").join(input_stats(local), "field_id").withColumn("f", F.col("card") / F.col("n"))
    return full.select(
        "field_id", "global_id", "n", "avglen", "maxlen", "f",
        (F.col("f") * F.log2("maxlen")).alias("term1"), ((1 - F.col("f")) * 8 * F.col("avglen")).alias("term2"),
        (F.col("f") / F.col("n") * (F.col("l") * F.col("lg_i") + F.col("i") * F.col("lg_l"))).alias("term3"),
    )


def scores(local: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(field_id, global_id, score): the share of the base length that the dictionary saves, 0 at least."""
    saved = 1 - F.try_divide(F.col("term1") + F.col("term2") + F.col("term3"), 8 * F.col("avglen"))
    return description_length(local, dictionary).select("field_id", "global_id", F.greatest(F.lit(0.0), F.coalesce(saved, F.lit(0.0))).alias("score"))
