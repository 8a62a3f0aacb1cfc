"""Existence checks against Spark's catalog."""

from __future__ import annotations

from pyspark.sql import SparkSession


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def schema_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.databaseExists(name)


def view_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType in ("VIEW", "TEMPORARY")


def index_exists(spark: SparkSession, name: str) -> bool:
    """Spark tables have no indexes."""
    return False
