from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_operators import edge_documents


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).checkpoint()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1]
    assert docs.select("doc_id").distinct().count() <= sizes[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.where("piece = 0").count() == sizes[3]


def test_entry_has_the_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{i}_" for i in range(1, 14)} <= {n[: n.index("_") + 1] for n in names if n.startswith("op")} and "pipeline" in names


def test_pipeline_over_edge_cases(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names and an empty table, through every stage."""
    plain = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = edge_documents(spark).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    docs = plain.unionByName(odd, allowMissingColumns=True)
    plain_labels = spark.read.parquet(f"{DATA}/labels.parquet")
    none = plain_labels.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in plain_labels.schema])
    place = str(tmp_path)
    plain_labels.unionByName(none).unionByName(plain_labels.limit(3)).write.parquet(f"{place}/labels.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, place).checkpoint()
        assert kept.columns == columns, name
        assert kept.select("doc_id", "text").distinct().join(before.select("doc_id", "text").distinct(), ["doc_id", "text"], "left_anti").where("doc_id is not null and text is not null").isEmpty(), name
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, place)
    assert packed.where("piece = 0").count() == kept.count() and packed.where("length > 4096").isEmpty()
    # Each stage by itself over nothing but edge cases, and over nothing.
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, place).count() >= 0, name
        assert stage(spark, docs.limit(0), place).count() == 0, name
