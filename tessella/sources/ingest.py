"""Ingestion of wide tables and of staged name/value tables into the cell model.

Cell model: sources (source_id, local_id), fields (field_id, source_id, name), entities (entity_id, source_id, local_id),
cells (source_id, field_id, entity_id, value), all values text. Identifiers are 64-bit hashes of natural keys: they need no
global numbering, and ingesting the same data again gives the same identifiers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest value of a staged table and largest source that are imported.
LONGEST_VALUE, LARGEST_SOURCE = 1300, 10**7


@dataclass(frozen=True)
class Ingested:
    sources: DataFrame
    fields: DataFrame
    entities: DataFrame
    cells: DataFrame


def _model(cells: DataFrame, fields: DataFrame | None = None) -> Ingested:
    """The model of cells (source, field, entity, value) by natural keys."""
    source, field, entity = F.xxhash64("source"), F.xxhash64("source", "field"), F.xxhash64("source", "entity", F.lit("entity"))
    named = cells.select("source", "field").distinct() if fields is None else fields.select("source", "field").distinct()
    return Ingested(
        cells.select("source").distinct().select(source.alias("source_id"), F.col("source").alias("local_id")),
        named.select(field.alias("field_id"), source.alias("source_id"), F.col("field").alias("name")),
        cells.select("source", "entity").distinct().select(entity.alias("entity_id"), source.alias("source_id"), F.col("entity").alias("local_id")),
        cells.select(source.alias("source_id"), field.alias("field_id"), entity.alias("entity_id"), "value"),
    )


def wide_cells(table: DataFrame, name: str, columns: list[str], source_key: str | None = None, entity_key: str | None = None) -> DataFrame:
    """(source, field, entity, value) of the chosen columns; null and empty values have no cell.

    The source is the table's name and the source key (0 without one). The entity is its key, or else the digest of its source's
    and columns' values and a number among equal rows: the same rows get the same entities however they are partitioned. Equal
    rows are counted, not numbered by a sort, so that no task holds them all.
    """
    key = F.col(source_key).cast("string") if source_key else F.lit("0")
    values = [F.col(c).cast("string").alias(c) for c in columns]
    if entity_key:
        rows = table.select(F.concat_ws("/", F.lit(name), key).alias("_source"), F.col(entity_key).cast("string").alias("_entity"), *values)
    else:
        same = table.select(F.concat_ws("/", F.lit(name), key).alias("_source"), *values).groupBy("_source", *columns).agg(F.count("*").alias("_n"))
        number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))
        digest = F.md5(F.to_json(F.array(*[F.col(c) for c in columns])))
        rows = same.select("_source", *columns, number.alias("_k")).select("_source", F.concat(digest, F.lit("#"), F.col("_k").cast("string")).alias("_entity"), *columns)
    return rows.unpivot(["_source", "_entity"], columns, "field", "value").where("value is not null and value <> ''").select(F.col("_source").alias("source"), "field", F.col("_entity").alias("entity"), "value")


def from_wide(table: DataFrame, name: str, columns: list[str], source_key: str | None = None, entity_key: str | None = None) -> Ingested:
    return _model(wide_cells(table, name, columns, source_key, entity_key))


def staged_cells(data: DataFrame) -> DataFrame:
    """(source, field, entity, value) of staged (source_id, entity_id, name, value): empty values stay, null and long ones go."""
    rows = data.where(F.col("value").isNotNull() & (F.length("value") < LONGEST_VALUE))
    return rows.select(F.col("source_id").cast("string").alias("source"), F.col("name").alias("field"), F.col("entity_id").cast("string").alias("entity"), "value")


def from_staged(data: DataFrame, fields: DataFrame | None = None) -> Ingested:
    """The model of staged data; fields (source_id, name) may list fields without values."""
    listed = None if fields is None else fields.select(F.col("source_id").cast("string").alias("source"), F.col("name").alias("field"))
    return _model(staged_cells(data), listed)


def random_sources(staged: DataFrame, n: int, imported: DataFrame | None = None, largest: int = LARGEST_SOURCE, seed: str = "sources") -> DataFrame:
    """n of the staged sources (source_id, n_values) not yet imported and not too large, in an order by hash."""
    rows = staged if imported is None else staged.join(imported.select("source_id").distinct(), "source_id", "left_anti")
    return rows.where(F.col("n_values") < largest).orderBy(F.md5(F.concat(F.lit(seed), F.col("source_id").cast("string"))), "source_id").limit(n)


def training_load(fields: DataFrame, data: DataFrame) -> tuple[Ingested, DataFrame, DataFrame]:
    """(model, attributes, mappings): staged sources with tagged fields (source_id, name, tag_code), imported and mapped."""
    got = from_staged(data, fields)
    named = fields.select(F.xxhash64(F.col("source_id").cast("string")).alias("source_id"), "name", "tag_code")
    attributes, mapped = training_mappings(got.fields.join(named, ["source_id", "name"]))
    return got, attributes, mapped


def import_random(data: DataFrame, staged: DataFrame, n: int, imported: DataFrame | None = None, seed: str = "sources") -> Ingested:
    """random_sources ingested in one job."""
    return from_staged(data.join(F.broadcast(random_sources(staged, n, imported, seed=seed).select("source_id")), "source_id", "left_semi"))


def dictionary(table: DataFrame, column: str, attributes: DataFrame, attribute: str) -> DataFrame:
    """(att_id, value): a column as the dictionary of the attribute of that name, in any case."""
    own = attributes.where(F.lower("name") == attribute.lower()).select(F.col("global_id").alias("att_id"))
    return table.select(F.col(column).cast("string").alias("value")).where("value is not null").crossJoin(F.broadcast(own)).select("att_id", "value")


def synonyms(table: DataFrame, att_id: int, first: str, second: str) -> DataFrame:
    """(att_id, value_a, value_b) with the two values in order, each pair once."""
    rows = table.select(F.col(first).cast("string").alias("x"), F.col(second).cast("string").alias("y")).dropna()
    return rows.select(F.lit(att_id).cast("long").alias("att_id"), F.least("x", "y").alias("value_a"), F.greatest("x", "y").alias("value_b")).distinct()


def template(members: DataFrame, column: str, template_id: int, attributes: DataFrame) -> DataFrame:
    """(template_id, att_id): attributes whose name equals a member's, in any case."""
    rows = members.select(F.lower(F.col(column)).alias("key")).distinct()
    return attributes.withColumn("key", F.lower("name")).join(rows, "key", "left_semi").select(F.lit(template_id).cast("long").alias("template_id"), F.col("global_id").alias("att_id"))


def global_schema(table: DataFrame, column: str, derived_from: str = "WEB") -> DataFrame:
    """(global_id, name, derived_from, type): an attribute for each distinct name."""
    names = table.select(F.col(column).cast("string").alias("name")).where("name is not null").distinct()
    return names.select(F.xxhash64("name").alias("global_id"), "name", F.lit(derived_from).alias("derived_from"), F.lit("TEXT").alias("type"))


def training_mappings(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attributes, mappings) of fields (field_id, name, tag_code): an attribute for each tag, each tagged field mapped with full confidence."""
    tagged = fields.where("tag_code is not null")
    attributes = global_schema(tagged, "tag_code", "TRAINING")
    mappings = tagged.join(attributes.select("global_id", F.col("name").alias("tag_code")), "tag_code").select(F.col("field_id").alias("local_id"), "global_id", F.lit(1.0).alias("confidence"), F.lit(1.0).alias("authority"), F.lit("TRAINING").alias("why_created"))
    return attributes, mappings


def tables(spark: SparkSession, database: str) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))


def table_attributes(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table)]


def mapping_rows(rows: DataFrame, who: int, authority: float = 0.5) -> DataFrame:
    """Mappings of answers (local_id, global_id, pct): confidence is a percentage."""
    return rows.select("local_id", "global_id", (F.col("pct") / 100).alias("confidence"), F.lit(authority).alias("authority"), F.lit(who).cast("long").alias("who_created"))


def answer_rows(rows: DataFrame, who: int, authority: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(mappings, rejected) of answers (local_id, global_id, pct, is_match)."""
    rejected = rows.where("not is_match").select("local_id", "global_id", F.lit(who).cast("long").alias("who_created"))
    return mapping_rows(rows.where("is_match"), who, authority), rejected


def suggestion_rows(rows: DataFrame, who: str) -> DataFrame:
    """New attributes that users propose, of (name, reference_field_id, comment); the time is that of the write."""
    return rows.select(F.trim("name").alias("name"), "reference_field_id", "comment", F.lit(who).alias("suggested_by"), F.current_timestamp().alias("suggested_at"))
