"""Named queries over the driver's tables, and DuckDB SQL with the same results."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..cluster import ship_package

FLAGSHIP = "ncomp_max"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL that must give the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            # Without the hint DuckDB would run a statement used twice once for each use.
            ORACLES[f.__name__] = sql.strip() if "RECURSIVE" in sql else re.sub(r"\b(\w+) AS \(", r"\1 AS MATERIALIZED (", sql.strip())
        return f

    return add


from . import queries_dedup, queries_explore, queries_functions, queries_matching  # noqa: E402, F401
