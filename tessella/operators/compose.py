"""Composition of the matchers' scores, mapping suggestions and their evaluation.

raw (source_id, field_id, method_name, match_id, score); methods (method_name, active, weight).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.aggregates import rank_first

METHODS = ("qgrams", "mdl", "ngrams", "dist")


def default_methods(spark: SparkSession) -> DataFrame:
    rows = [*((m, True, 1.0) for m in METHODS), ("val_qgrams", False, 1.0)]
    return spark.createDataFrame(rows, "method_name string, active boolean, weight double")


def raw_results(fields: DataFrame, **by_method: DataFrame) -> DataFrame:
    """One table of all matchers' (field_id, global_id, score), each pair once for each method."""
    parts = [s.select("field_id", F.lit(m).alias("method_name"), F.col("global_id").alias("match_id"), "score") for m, s in by_method.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.join(fields.select("field_id", "source_id"), "field_id").select("source_id", "field_id", "method_name", "match_id", "score")


def replace_results(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """state with the results of the same source and method replaced: scoring a source again changes nothing."""
    return state.join(fresh.select("source_id", "method_name").distinct(), ["source_id", "method_name"], "left_anti").unionByName(fresh)


def for_source(results: DataFrame, source_id: int) -> DataFrame:
    return results.where(F.col("source_id") == source_id)


def for_fields(fields: DataFrame, predicate: str) -> DataFrame:
    """The fields for which a SQL predicate holds; scoring them alone needs no other fields."""
    return fields.where(F.expr(predicate))


def unmapped(fields: DataFrame, mappings: DataFrame) -> DataFrame:
    """Fields without any mapping."""
    return fields.join(mappings.select(F.col("local_id").alias("field_id")), "field_id", "left_anti")


def raw_max_scores(raw: DataFrame) -> DataFrame:
    return raw.groupBy("field_id", "method_name").agg(F.max("score").alias("score"))


def raw_max(raw: DataFrame) -> DataFrame:
    """The matches of the highest score of each field and method; ties stay."""
    return rank_first(raw, ["field_id", "method_name"], F.desc("score"))


def composite(raw: DataFrame, methods: DataFrame) -> DataFrame:
    """(source_id, field_id, match_id, score): the sum of squared weighted scores of active methods."""
    known = raw.join(F.broadcast(methods.where("active")), "method_name")
    return known.groupBy("source_id", "field_id", "match_id").agg(F.sum(F.pow(F.col("score") * F.col("weight"), 2)).alias("score"))


def composite_max(raw: DataFrame, methods: DataFrame) -> DataFrame:
    return rank_first(composite(raw, methods), ["field_id"], F.desc("score"))


def votes(raw: DataFrame, methods: DataFrame) -> DataFrame:
    """(source_id, field_id, match_id, score): the sum of weights of methods whose best match it is, active or not."""
    return raw_max(raw).join(F.broadcast(methods), "method_name").groupBy("source_id", "field_id", "match_id").agg(F.sum("weight").alias("score"))


def votes_max(raw: DataFrame, methods: DataFrame) -> DataFrame:
    return rank_first(votes(raw, methods), ["field_id"], F.desc("score"))


def field_mappings(fields: DataFrame, attributes: DataFrame, mappings: DataFrame, composed: DataFrame, only_unmapped: bool = False) -> DataFrame:
    """(field_id, name, match_id, match_name, score, mapped, candidates) of every field.

    A mapped field shows its mapping with a score of 2, another one its best candidate, or ``Unknown`` without any;
    candidates are all scored attributes from the best on.
    """
    named = composed.join(attributes.select(F.col("global_id").alias("match_id"), F.col("name").alias("match_name")), "match_id")
    ranked = named.groupBy("field_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "match_id", "match_name"))).alias("ranked"))
    mapped = mappings.join(attributes, "global_id").groupBy(F.col("local_id").alias("field_id")).agg(F.min(F.struct(F.col("global_id").alias("match_id"), F.col("name").alias("match_name"))).alias("m"))
    rows = fields.join(ranked, "field_id", "left").join(mapped, "field_id", "left")
    best = F.get("ranked", F.lit(0))
    out = rows.select(
        "field_id", "name", F.coalesce("m.match_id", best["match_id"]).alias("match_id"), F.coalesce("m.match_name", best["match_name"], F.lit("Unknown")).alias("match_name"),
        F.when(F.col("m").isNotNull(), 2.0).otherwise(F.coalesce(-best["minus"], F.lit(0.0))).alias("score"), F.col("m").isNotNull().alias("mapped"), F.transform("ranked", lambda r: r["match_id"]).alias("candidates"),
    )
    return out.where("not mapped") if only_unmapped else out


def auto_accept(fields: DataFrame, mappings: DataFrame, composed: DataFrame, threshold: float) -> DataFrame:
    """New mappings for unmapped fields whose best score reaches the threshold."""
    best = rank_first(composed, ["field_id"], F.desc("score"), F.col("match_id")).where(F.col("score") >= threshold)
    return best.join(mappings.select(F.col("local_id").alias("field_id")), "field_id", "left_anti").join(fields.select("field_id"), "field_id", "left_semi").select(
        F.col("field_id").alias("local_id"), F.col("match_id").alias("global_id"), F.lit(1.0).alias("confidence"), F.lit(1.0).alias("authority"), F.lit(-2).cast("long").alias("who_created"), F.lit("AUTO").alias("why_created")
    )


def accuracy(results: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, correct, wrong, null_truth, total, success_rate, error_rate) of best matches against gold (field_id, tag_id)."""
    both = results.join(gold, "field_id")
    hit = F.col("match_id") == F.col("tag_id")
    out = both.groupBy(keys).agg(F.count_if(hit).alias("correct"), F.count_if(~hit).alias("wrong"), F.count_if(F.col("tag_id").isNull()).alias("null_truth"), F.count("*").alias("total"))
    return out.withColumns({"success_rate": F.try_divide("correct", F.col("correct") + F.col("wrong")), "error_rate": F.try_divide("wrong", F.col("correct") + F.col("wrong"))})


def weight_search(raw: DataFrame, gold: DataFrame, trials: DataFrame) -> DataFrame:
    """(trial, correct, total) of composites under many weightings in one pass; trials (trial, method_name, weight)."""
    scored = raw.join(F.broadcast(trials), "method_name").groupBy("trial", "field_id", "match_id").agg(F.sum(F.pow(F.col("score") * F.col("weight"), 2)).alias("score"))
    best = rank_first(scored, ["trial", "field_id"], F.desc("score"), F.col("match_id"))
    return best.join(gold.where("tag_id is not null"), "field_id").groupBy("trial").agg(F.count_if(F.col("match_id") == F.col("tag_id")).alias("correct"), F.count("*").alias("total"))


def score_pivot(raw: DataFrame) -> DataFrame:
    """(field_id, match_id, one column for each matcher, 0 where it has no score)."""
    return raw.groupBy("field_id", "match_id").pivot("method_name", list(METHODS)).agg(F.max("score")).fillna(0.0, list(METHODS))


def scores_with_composite(raw: DataFrame, methods: DataFrame) -> DataFrame:
    """score_pivot with the pair's composite score."""
    return score_pivot(raw).join(composite(raw, methods).select("field_id", "match_id", F.col("score").alias("composite")), ["field_id", "match_id"], "left").fillna(0.0, ["composite"])


def random_weights(spark: SparkSession, trials: int, seed: int = 1) -> DataFrame:
    """(trial, method_name, weight): random weights from 0 to 1 of every matcher, the same for the same seed."""
    rows = spark.range(1, trials + 1).withColumnRenamed("id", "trial").withColumn("method_name", F.explode(F.array(*map(F.lit, METHODS))))
    return rows.withColumn("weight", F.pmod(F.xxhash64("trial", "method_name", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))


def questions(composed: DataFrame, fields: DataFrame, attributes: DataFrame, mappings: DataFrame, k: int = 10) -> DataFrame:
    """(field_id, match_id, score, place): k best candidates of each unmapped field, then all other attributes without a score."""
    asked = unmapped(fields, mappings).select("field_id")
    place = F.row_number().over(Window.partitionBy("field_id").orderBy(F.desc("score"), "match_id"))
    top = composed.join(asked, "field_id", "left_semi").withColumn("place", place).where(F.col("place") <= k).select("field_id", "match_id", "score", F.col("place").cast("long").alias("place"))
    rest = asked.crossJoin(F.broadcast(attributes.select(F.col("global_id").alias("match_id")))).join(top, ["field_id", "match_id"], "left_anti")
    return top.unionByName(rest.select("field_id", "match_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("place")))
