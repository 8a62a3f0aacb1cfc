"""Affinities of local fields to global attributes, from recorded mappings.

mappings: (local_id, global_id, confidence, authority). Any number of mappings may exist for a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import rank_first

#: Affinity from which a mapping trains the matchers.
TRAINING_THRESHOLD = 0.5


def affinities(mappings: DataFrame) -> DataFrame:
    """(local_id, global_id, affinity): the sum of confidence times authority, within 0 and 1."""
    total = F.sum(F.col("authority") * F.col("confidence"))
    return mappings.groupBy("local_id", "global_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("affinity"))


def max_affinities(mappings: DataFrame) -> DataFrame:
    """The attributes of a field's highest affinity; ties stay."""
    return rank_first(affinities(mappings), ["local_id"], F.desc("affinity"))


def training_mappings(mappings: DataFrame, threshold: float = TRAINING_THRESHOLD) -> DataFrame:
    """Affinities that reach the threshold."""
    return affinities(mappings).where(F.col("affinity") >= threshold)
