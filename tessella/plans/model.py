"""The curation model of the driver's tables, as DataFrames and as SQL that DuckDB runs on the same tables.

Four tables are sources; their columns are fields, their rows entities. Real columns are put into text with two decimals, so
that both engines write the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import affinity as aff

#: (source_id, table, key, columns); field ids count through the columns in order.
SOURCES = (
    (1, "customer", "c_custkey", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
    (2, "supplier", "s_suppkey", ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")),
    (3, "part", "p_partkey", ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
    (4, "nation", "n_nationkey", ("n_nationkey", "n_name", "n_regionkey")),
)
REALS = ("c_acctbal", "s_acctbal", "p_retailprice")
ATTRIBUTES = ("NAME", "NATIONKEY", "ACCTBAL", "MKTSEGMENT", "BRAND", "TYPE", "SIZE", "RETAILPRICE", "REGIONKEY")
#: (field, attribute, confidence, authority): the supplier's fields are mapped for sure.
SURE = ((7, 1, 1.0, 1.0), (8, 2, 1.0, 1.0), (9, 3, 1.0, 1.0))
#: More feedback, with repeated and weak mappings.
MAPPINGS = (*SURE, (5, 4, 0.8, 0.5), (5, 4, 0.9, 1.0), (12, 5, 1.0, 0.5), (13, 6, 0.9, 0.9), (13, 5, 0.3, 0.4), (14, 7, 1.0, 1.0), (17, 1, 0.7, 0.6))
FIELDS = tuple((i + 1, s, c) for i, (s, c) in enumerate((s, c) for s, _, _, cols in SOURCES for c in cols))
STEP = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIELDS, "field_id long, source_id long, name string")


def attributes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, a) for i, a in enumerate(ATTRIBUTES)], "global_id long, name string")


def mappings(spark: SparkSession, rows=MAPPINGS) -> DataFrame:
    return spark.createDataFrame(rows, "local_id long, global_id long, confidence double, authority double")


def affinity(spark: SparkSession, rows=MAPPINGS) -> DataFrame:
    return aff.affinities(mappings(spark, rows))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, field_id, entity_id, value) of the four sources."""
    number = {c: i for i, _, c in FIELDS}
    out = None
    for source, name, key, columns in SOURCES:
        text = [F.col(c).cast("decimal(18,2)").cast("string").alias(c) if c in REALS else F.col(c).cast("string").alias(c) for c in columns]
        rows = table(spark, sf_dir, name).select((F.lit(source * STEP) + F.col(key)).cast("long").alias("entity_id"), *text).unpivot("entity_id", list(columns), "name", "value")
        ids = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(number[c]).cast("long"))])
        part = rows.where("value is not null and value <> ''").select(F.lit(source).cast("long").alias("source_id"), ids[F.col("name")].alias("field_id"), "entity_id", "value")
        out = part if out is None else out.unionByName(part)
    return out


def _values(rows) -> str:
    def lit(x) -> str:
        return f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else f"{x}::BIGINT"

    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def _sql_cells() -> str:
    number, out = {c: i for i, _, c in FIELDS}, []
    for source, name, key, columns in SOURCES:
        for c in columns:
            text = f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)" if c in REALS else f"CAST({c} AS VARCHAR)"
            out.append(f"SELECT {source}::BIGINT AS source_id, {number[c]}::BIGINT AS field_id, ({source * STEP} + {key})::BIGINT AS entity_id, {text} AS value FROM {name} WHERE {c} IS NOT NULL AND {text} <> ''")
    return "cells AS (" + " UNION ALL ".join(out) + ")"


S_FIELDS = f"fields(field_id, source_id, name) AS (VALUES {_values(FIELDS)})"
S_ATTRIBUTES = f"attributes(global_id, name) AS (VALUES {_values((i + 1, a) for i, a in enumerate(ATTRIBUTES))})"
S_CELLS = _sql_cells()


def s_affinity(rows=MAPPINGS) -> str:
    return f"mappings(local_id, global_id, confidence, authority) AS (VALUES {_values(rows)}), affinity AS (SELECT local_id, global_id, greatest(0.0, least(1.0, sum(confidence * authority)))::DOUBLE AS affinity FROM mappings GROUP BY ALL)"


def s_grams(out: str, source: str, keys: str, text: str) -> str:
    """CTEs that put the q-grams (q = 3) of a text column of source into out(keys, gram), with repeats."""
    k = ", ".join(keys.split())
    words = f"list_filter(string_split_regex(lower({text}), '\\s+'), lambda w: w <> '')"
    return (
        f"{out}_l AS (SELECT {k}, {words} AS ws FROM {source} WHERE {text} IS NOT NULL), {out}_w AS (SELECT {k}, unnest(ws) AS w, unnest(list_append(ws[2:], NULL)) AS nxt FROM {out}_l), "
        f"{out} AS (SELECT {k}, substr(w, 1, 3) || '!' AS gram FROM {out}_w UNION ALL SELECT {k}, substr(w, 1, 1) || '#' FROM {out}_w "
        f"UNION ALL SELECT {k}, substr(w, 1, 1) || ' ' || substr(nxt, 1, 1) FROM {out}_w WHERE nxt IS NOT NULL "
        f"UNION ALL SELECT {k}, unnest(list_transform(range(1, length(w) - 1), lambda p: substr(w, p, 3))) FROM {out}_w WHERE length(w) >= 3)"
    )


def s_words(out: str, source: str, keys: str, text: str) -> str:
    """CTE out(keys, token): lower-case words between white space, with repeats."""
    k = ", ".join(keys.split())
    return f"{out} AS (SELECT {k}, unnest(list_filter(string_split_regex(lower({text}), '\\s+'), lambda w: w <> '')) AS token FROM {source} WHERE {text} IS NOT NULL)"


def s_delimited(out: str, source: str, text: str) -> str:
    """Recursive CTEs that put the spans between the cut points of source's distinct texts into out(text, piece)."""
    here, after = f"substr({text}, pos + 1, 1)", f"substr({text}, pos + 2, 1)"
    mark = lambda c: f"({c} <> '' AND NOT regexp_matches({c}, '[A-Za-z0-9]'))"
    digit = lambda c: f"regexp_matches({c}, '[0-9]')"
    turn = f"({after} <> '' AND ((regexp_matches({here}, '[a-z]') AND regexp_matches({after}, '[A-Z]')) OR {digit(here)} <> {digit(after)}))"
    return (
        f"{out}_s AS (SELECT DISTINCT {text}, 0 AS pos, 0 AS cut FROM {source} WHERE {text} IS NOT NULL UNION ALL SELECT {text}, pos + CASE WHEN {mark(here)} OR {mark(after)} THEN 1 WHEN {turn} THEN 2 ELSE 1 END, "
        f"CASE WHEN {mark(here)} OR {mark(after)} OR {turn} THEN pos + 1 ELSE 0 END FROM {out}_s WHERE pos < length({text})), "
        f"{out}_c AS (SELECT {text}, cut FROM {out}_s UNION SELECT {text}, length({text})::INTEGER FROM {out}_s), {out} AS (SELECT DISTINCT x.{text}, substr(x.{text}, x.cut + 1, y.cut - x.cut) AS piece FROM {out}_c x JOIN {out}_c y ON x.{text} = y.{text} AND x.cut < y.cut)"
    )
