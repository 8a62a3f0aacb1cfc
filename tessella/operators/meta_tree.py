"""A decision tree over the matchers' scores; label 1 is a mapped pair."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .compose import METHODS, score_pivot


def labelled_features(raw: DataFrame, mappings: DataFrame) -> DataFrame:
    """(field_id, match_id, scores, label): label 1 where the pair is mapped."""
    known = mappings.select(F.col("local_id").alias("field_id"), F.col("global_id").alias("match_id")).distinct().withColumn("label", F.lit(1.0))
    return score_pivot(raw).join(known, ["field_id", "match_id"], "left").fillna(0.0, ["label"])


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(METHODS), outputCol="features").transform(rows)


def train(features: DataFrame, depth: int = 5, seed: int = 7) -> DecisionTreeClassificationModel:
    return DecisionTreeClassifier(maxDepth=depth, seed=seed).fit(_vectors(features))


def classify(model: DecisionTreeClassificationModel, features: DataFrame) -> DataFrame:
    """(field_id, match_id, label, class, prob)."""
    return model.transform(_vectors(features)).select("field_id", "match_id", "label", F.col("prediction").alias("class"), F.element_at(vector_to_array("probability"), 2).alias("prob"))


def stats(classified: DataFrame, accepted: float = 1.0) -> DataFrame:
    """(true_positive, false_positive, false_negative, true_negative) with ``accepted`` the class that maps."""
    yes, truth = F.col("class") == accepted, F.col("label") == 1.0
    return classified.agg(F.count_if(yes & truth).alias("true_positive"), F.count_if(yes & ~truth).alias("false_positive"), F.count_if(~yes & truth).alias("false_negative"), F.count_if(~yes & ~truth).alias("true_negative"))


def measures(counted: DataFrame) -> DataFrame:
    """(recall, precision, f) of stats; null where undefined."""
    rows = counted.select(F.try_divide("true_positive", F.col("true_positive") + F.col("false_negative")).alias("recall"), F.try_divide("true_positive", F.col("true_positive") + F.col("false_positive")).alias("precision"))
    return rows.withColumn("f", F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")))


def split_test(raw: DataFrame, mappings: DataFrame, fields: DataFrame, seed: str = "tree") -> DataFrame:
    """Measures of a tree trained on one half of the fields, dealt by hash, and tested on the other."""
    rows = labelled_features(raw, mappings).withColumn("half", F.pmod(F.xxhash64("field_id", F.lit(seed)), F.lit(2)))
    return measures(stats(classify(train(rows.where("half = 0")), rows.where("half = 1"))))
