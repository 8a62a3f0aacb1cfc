"""Matcher 2: TF-IDF cosine of value tokens.

cells (source_id, field_id, entity_id, value), dictionary (global_id, value), affinity (local_id, global_id, affinity).
The tokenizer is a function of a column to an array column, or a StemTokenizer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import typed_stems
from .vectors import cosine, norms, text_terms, weighted


def words(text: Column) -> Column:
    """Lower-case words between white space; the plain tokenizer."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def local_tokens(cells: DataFrame, tokenizer: Callable[[Column], Column] = typed_stems) -> DataFrame:
    """(source_id, field_id, gram, c, tf) with tf the share of the field's tokens."""
    counts = text_terms(cells, ["source_id", "field_id"], "value", tokenizer, "gram")
    return _shares(counts, "field_id")


def global_tokens(local: DataFrame, dictionary: DataFrame, affinity: DataFrame, tokenizer: Callable[[Column], Column] = typed_stems) -> DataFrame:
    """(global_id, gram, c, tf): token counts of mapped fields by affinity and of the attribute's dictionary, added up."""
    mapped = local.join(affinity, F.col("field_id") == F.col("local_id")).select("global_id", "gram", (F.col("c") * F.col("affinity")).alias("c"))
    own = text_terms(dictionary, ["global_id"], "value", tokenizer, "gram").select("global_id", "gram", F.col("c").cast("double").alias("c"))
    return _shares(merge_counts(mapped, own), "global_id")


def _shares(counts: DataFrame, key: str) -> DataFrame:
    """counts with tf = c over the sum of the key's counts: totals are aggregated and joined, no task holds all tokens of a key."""
    return counts.join(counts.groupBy(key).agg(F.sum("c").alias("_all")), key).withColumn("tf", F.try_divide("c", "_all")).drop("_all")


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Counts of the same (global_id, gram) added up: counts form a monoid, so batches may be merged in any order."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("global_id", "gram").agg(F.sum("c").alias("c"))


def token_idf(glob: DataFrame, attributes: DataFrame) -> DataFrame:
    """(gram, idf) with sqrt(ln(N / df)) of tokens that an attribute has."""
    n = attributes.agg(F.count("*").alias("n"))
    return glob.groupBy("gram").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("gram", F.sqrt(F.log(F.col("n") / F.col("df"))).alias("idf"))


def token_norms(vectors: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    return norms(weighted(vectors, idf, "gram"), [key])


def scores(cells: DataFrame, dictionary: DataFrame, attributes: DataFrame, affinity: DataFrame, tokenizer: Callable[[Column], Column] = typed_stems) -> DataFrame:
    """(field_id, global_id, score)."""
    local = local_tokens(cells, tokenizer)
    glob = global_tokens(local, dictionary, affinity, tokenizer)
    idf = token_idf(glob, attributes)
    return cosine(weighted(local, idf, "gram"), weighted(glob, idf, "gram"), "gram", "field_id", "global_id")
