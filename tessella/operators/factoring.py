"""Factoring of run-on attribute names: known terms are cut out, delimited substrings of what is left are looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import group_concat
from ..functions.text import delimited, remove_substrings


def knockout_terms(fields: DataFrame, affinity: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(field_id, name, terms): synonyms (global_id, synonym) of affine attributes that occur in the field's name, in any case."""
    both = fields.join(affinity, F.col("field_id") == F.col("local_id")).join(synonyms, "global_id")
    hits = both.where(F.contains(F.lower("name"), F.lower("synonym"))).select("field_id", "name", "synonym").distinct()
    return hits.groupBy("field_id", "name").agg(group_concat(F.col("synonym"), ",").alias("terms"))


def knockouts(terms: DataFrame) -> DataFrame:
    """(field_id, name, rest): names without their known terms."""
    return terms.select("field_id", "name", remove_substrings(F.col("name"), F.col("terms")).alias("rest"))


def leftovers(knocked: DataFrame) -> DataFrame:
    """(field_id, token): delimited substrings of what is left."""
    return knocked.select("field_id", F.explode(delimited(F.col("rest"))).alias("token"))


def hidden_gems(left: DataFrame, terms: DataFrame) -> DataFrame:
    """Leftovers that a dictionary (token, pterm) knows."""
    return left.join(terms, "token").select("field_id", "token", "pterm")
