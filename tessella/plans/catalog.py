"""A catalogue of sources that the driver's tables give, as DataFrames and as SQL: it grows with the parts.

A brand is a source, each type of part that it sells a field, named after type and brand; a type is a global attribute. Parts whose
size is a multiple of 5 are feedback: each maps its brand's field onto its type, with a confidence by its size and an authority of
one half or one. Ids are the smallest part keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import table


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("key"), "p_brand", "p_type", "p_size")


def _brand():
    return F.lower(F.regexp_replace("p_brand", "#", "_"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, local_id)."""
    return _parts(spark, sf_dir).groupBy("p_brand").agg(F.min("key").alias("source_id")).select("source_id", F.col("p_brand").alias("local_id"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _parts(spark, sf_dir).groupBy("p_brand", "p_type").agg(F.min("key").alias("field_id"))
    return held.join(sources(spark, sf_dir).withColumnRenamed("local_id", "p_brand"), "p_brand")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_id, source_id, name)."""
    return _fields(spark, sf_dir).select("field_id", "source_id", F.concat(F.lower("p_type"), F.lit(" "), _brand()).alias("name"))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(global_id, name)."""
    return _parts(spark, sf_dir).groupBy("p_type").agg(F.min("key").alias("global_id")).select("global_id", F.col("p_type").alias("name"))


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(local_id, global_id, confidence, authority, who_created): two users take turns by part key."""
    known = _fields(spark, sf_dir).select("p_brand", "p_type", F.col("field_id").alias("local_id"))
    rows = _parts(spark, sf_dir).where("p_size % 5 = 0").join(known, ["p_brand", "p_type"]).join(attributes(spark, sf_dir).withColumnRenamed("name", "p_type"), "p_type")
    return rows.select("local_id", "global_id", (F.col("p_size") / 100.0).alias("confidence"), F.when(F.col("key") % 2 == 0, 0.5).otherwise(1.0).alias("authority"), F.when(F.col("key") % 2 == 0, 7).otherwise(8).alias("who_created"))


def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(local_id, who_created) of answers that a field has no match."""
    known = _fields(spark, sf_dir).select("p_brand", "p_type", F.col("field_id").alias("local_id"))
    return _parts(spark, sf_dir).where("p_size = 1").join(known, ["p_brand", "p_type"]).select("local_id", F.when(F.col("key") % 2 == 0, 7).otherwise(9).alias("who_created")).distinct()


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(global_id, synonym): the words of an attribute's name."""
    return attributes(spark, sf_dir).select("global_id", F.explode(F.split("name", " ")).alias("synonym")).where("synonym <> ''").distinct()


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, pterm): how the brands are written in names."""
    return _parts(spark, sf_dir).select(_brand().alias("token"), F.col("p_brand").alias("pterm")).distinct()


S_SOURCES = "src AS (SELECT min(p_partkey)::BIGINT AS source_id, p_brand AS local_id FROM part GROUP BY p_brand)"
S_FIELDS = (
    f"{S_SOURCES}, held AS (SELECT p_brand, p_type, min(p_partkey)::BIGINT AS field_id FROM part GROUP BY ALL), "
    "fields AS (SELECT field_id, source_id, lower(p_type) || ' ' || lower(replace(p_brand, '#', '_')) AS name FROM held JOIN src ON local_id = p_brand)"
)
S_ATTRIBUTES = "attributes AS (SELECT min(p_partkey)::BIGINT AS global_id, p_type AS name FROM part GROUP BY p_type)"
S_AFFINITY = (
    "mappings AS (SELECT field_id AS local_id, global_id, p_size / 100.0::DOUBLE AS confidence, CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS authority, CASE WHEN p_partkey % 2 = 0 THEN 7 ELSE 8 END AS who_created "
    "FROM part JOIN held USING (p_brand, p_type) JOIN attributes a ON a.name = p_type WHERE p_size % 5 = 0), affinity AS (SELECT local_id, global_id, greatest(0.0, least(1.0, sum(confidence * authority)))::DOUBLE AS affinity FROM mappings GROUP BY ALL)"
)
S_REJECTED = "rejected AS (SELECT DISTINCT field_id AS local_id, CASE WHEN p_partkey % 2 = 0 THEN 7 ELSE 9 END AS who_created FROM part JOIN held USING (p_brand, p_type) WHERE p_size = 1)"
S_SYNONYMS = "sy AS (SELECT DISTINCT global_id, synonym FROM (SELECT global_id, unnest(string_split(name, ' ')) AS synonym FROM attributes) WHERE synonym <> '')"
S_TERMS = "tm AS (SELECT DISTINCT lower(replace(p_brand, '#', '_')) AS token, p_brand AS pterm FROM part)"
