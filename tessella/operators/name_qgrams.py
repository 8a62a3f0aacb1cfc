"""Matcher 1: q-grams of attribute names.

fields (source_id, field_id, name), attributes (global_id, name), affinity (local_id, global_id, affinity).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import qgrams
from .vectors import cosine, term_counts, weighted

Q = 3


def local_grams(fields: DataFrame) -> DataFrame:
    """(source_id, field_id, gram, c, tf) with tf = ln(1 + c)."""
    return term_counts(fields, ["source_id", "field_id"], qgrams(F.col("name"), Q), "gram").withColumn("tf", F.log(1.0 + F.col("c")))


def global_grams(local: DataFrame, attributes: DataFrame, affinity: DataFrame) -> DataFrame:
    """(global_id, gram, c, tf): counts of mapped fields by affinity, and of the attribute's own name for grams they lack."""
    mapped = local.join(affinity, F.col("field_id") == F.col("local_id")).groupBy("global_id", "gram").agg(F.sum(F.col("c") * F.col("affinity")).alias("c"))
    own = term_counts(attributes, ["global_id"], qgrams(F.col("name"), Q), "gram").withColumn("c", F.col("c").cast("double"))
    both = mapped.unionByName(own.join(mapped, ["global_id", "gram"], "left_anti"))
    return both.withColumn("tf", F.log(1.0 + F.col("c")))


def gram_idf(local: DataFrame, glob: DataFrame, attributes: DataFrame) -> DataFrame:
    """(gram, idf) with sqrt(ln(N / df)); grams that no attribute has count as held by one."""
    n = attributes.agg(F.count("*").alias("n"))
    df = glob.groupBy("gram").agg(F.count("*").alias("df"))
    words = local.select("gram").union(glob.select("gram")).distinct()
    return words.join(df, "gram", "left").crossJoin(F.broadcast(n)).select("gram", F.sqrt(F.log(F.col("n") / F.coalesce("df", F.lit(1)))).alias("idf"))


def scores(fields: DataFrame, attributes: DataFrame, affinity: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(field_id, global_id, score): TF-IDF cosine of fields and attributes that share a gram; of the wanted fields (field_id) only, if given.

    Attributes learn from mapped fields alone, so that others are cut away before any gram is made.
    """
    glob = global_grams(local_grams(fields.join(affinity.select(F.col("local_id").alias("field_id")).distinct(), "field_id", "left_semi")), attributes, affinity)
    local = local_grams(fields if wanted is None else fields.join(wanted.select("field_id"), "field_id", "left_semi"))
    idf = gram_idf(local, glob, attributes)
    return cosine(weighted(local, idf, "gram"), weighted(glob, idf, "gram"), "gram", "field_id", "global_id")
