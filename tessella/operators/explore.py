"""Exploration queries over sources, fields, mappings, values and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import first_rows, random_pick


def shuffled(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows in an order that looks random and repeats: by MD5 of seed and key."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def sources(srcs: DataFrame, fields: DataFrame, mappings: DataFrame) -> DataFrame:
    """(source_id, local_id, n_fields, n_mapped, ratio) of sources with fields."""
    done = mappings.select(F.col("local_id").alias("field_id")).distinct().withColumn("done", F.lit(1))
    counts = fields.join(done, "field_id", "left").groupBy("source_id").agg(F.count("*").alias("n_fields"), F.coalesce(F.sum("done"), F.lit(0)).alias("n_mapped"))
    return srcs.join(counts, "source_id").select("source_id", "local_id", "n_fields", "n_mapped", (F.col("n_mapped") / F.col("n_fields")).alias("ratio"))


def source_list(srcs: DataFrame, n: int) -> DataFrame:
    """(source_id, local_id) of the first n sources."""
    return srcs.select("source_id", "local_id").orderBy("source_id").limit(n)


def source_name(srcs: DataFrame, source_id: int) -> DataFrame:
    return srcs.where(F.col("source_id") == source_id).select("local_id")


def global_attributes(attributes: DataFrame) -> DataFrame:
    """(global_id, name) by name, without regard to case."""
    return attributes.select("global_id", "name").orderBy(F.lower("name"), "global_id")


def with_meta(srcs: DataFrame, meta: DataFrame, name: str) -> DataFrame:
    """srcs with the value of a meta entry, whatever the case of its name."""
    key = name.lower()
    return srcs.join(meta.where(F.upper("meta_name") == name.upper()).select("source_id", F.col("value").alias(key)), "source_id", "left")


def recent_sources(srcs: DataFrame, n: int) -> DataFrame:
    """(place, date_added, sources): counts by date with their place in time; one row for each date is windowed."""
    days = srcs.groupBy("date_added").agg(F.count("*").alias("sources"))
    return days.withColumn("place", F.row_number().over(Window.orderBy("date_added")).cast("long")).orderBy(F.desc("place")).limit(n)


def source_stats(fields: DataFrame, entities: DataFrame, mappings: DataFrame, clustering: DataFrame) -> DataFrame:
    """(source_id, n_entities, n_columns, n_mapped, n_duplicates)."""
    done = mappings.select(F.col("local_id").alias("field_id")).distinct().withColumn("done", F.lit(1))
    cols = fields.join(done, "field_id", "left").groupBy("source_id").agg(F.count("*").alias("n_columns"), F.coalesce(F.sum("done"), F.lit(0)).alias("n_mapped"))
    dup = clustering.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1").select("cluster_id")
    twin = clustering.join(dup, "cluster_id", "left_semi").select("entity_id").withColumn("twin", F.lit(1))
    ents = entities.join(twin, "entity_id", "left").groupBy("source_id").agg(F.count("*").alias("n_entities"), F.coalesce(F.sum("twin"), F.lit(0)).alias("n_duplicates"))
    return cols.join(ents, "source_id", "left").select("source_id", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), "n_columns", "n_mapped", F.coalesce("n_duplicates", F.lit(0)).alias("n_duplicates"))


def field_profile(cells: DataFrame) -> DataFrame:
    """(field_id, n_values, n_distinct, avg_val_len, sort_factor): sort_factor is the share of repeated values."""
    stats = cells.groupBy("field_id").agg(F.count("value").alias("n_values"), F.count_distinct("value").alias("n_distinct"), F.avg(F.length("value")).alias("avg_val_len"))
    return stats.withColumn("sort_factor", 1 - F.col("n_distinct") / F.col("n_values"))


def source_fields(fields: DataFrame, profile: DataFrame, source_id: int) -> DataFrame:
    return fields.where(F.col("source_id") == source_id).join(profile, "field_id").orderBy(F.round("sort_factor", 2), "avg_val_len", "field_id")


def source_entities(cells: DataFrame, source_id: int, n: int, seed: str = "entities") -> DataFrame:
    """(entity_id, cells): n entities of a source with their cells as a map."""
    own = cells.where(F.col("source_id") == source_id)
    chosen = shuffled(own.select("entity_id").distinct(), "entity_id", n, seed)
    return own.join(F.broadcast(chosen), "entity_id", "left_semi").groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("field_id", "value")))).alias("cells"))


def source_table(cells: DataFrame, fields: DataFrame, source_id: int) -> DataFrame:
    """The source as a rectangular table, '' where a cell is missing."""
    names = {r["field_id"]: r["name"] for r in fields.where(F.col("source_id") == source_id).orderBy("field_id").collect()}
    own = cells.where(F.col("source_id") == source_id)
    wide = own.groupBy("entity_id").agg(*[F.coalesce(F.min(F.when(F.col("field_id") == i, F.col("value"))), F.lit("")).alias(n) for i, n in names.items()])
    return wide


def meta(entries: DataFrame, key: str, value: int) -> DataFrame:
    return entries.where(F.col(key) == value).orderBy(F.desc("meta_name"), F.desc("value"))


def field_candidates(attributes: DataFrame, composed: DataFrame, field_id: int) -> DataFrame:
    """(global_id, name, score): all attributes with the field's composite score, 0 without one."""
    own = composed.where(F.col("field_id") == field_id).select(F.col("match_id").alias("global_id"), "score")
    return attributes.join(F.broadcast(own), "global_id", "left").select("global_id", "name", F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "global_id")


def fields_by_name(fields: DataFrame, name: str, exact: bool) -> DataFrame:
    pattern = name.lower() if exact else f"%{name.lower()}%"
    return fields.where(F.lower("name").like(pattern))


def mappings_by_name(fields: DataFrame, field_mappings: DataFrame, name: str, exact: bool) -> DataFrame:
    """field_mappings of the fields of that name."""
    return field_mappings.join(fields_by_name(fields, name, exact).select("field_id"), "field_id", "left_semi")


def field_detail(field_id: int, match_id: int, profile: DataFrame, local: DataFrame, glob: DataFrame, scores: DataFrame) -> DataFrame:
    """One row on a field and an attribute: the field's profile, how many values they share, and the matchers' scores with their composite."""
    shared = shared_values(local.where(F.col("field_id") == field_id), glob.where(F.col("global_id") == match_id)).agg(F.count("*").alias("n_shared"))
    own = scores.where((F.col("field_id") == field_id) & (F.col("match_id") == match_id))
    return profile.where(F.col("field_id") == field_id).join(own, "field_id", "left").crossJoin(F.broadcast(shared))


def unanswered(fields: DataFrame, mappings: DataFrame, antimappings: DataFrame, who: int) -> DataFrame:
    """Fields that a user has neither mapped nor rejected."""
    mine = lambda m: m.where(F.col("who_created") == who).select(F.col("local_id").alias("field_id"))
    return fields.join(mine(mappings), "field_id", "left_anti").join(mine(antimappings), "field_id", "left_anti")


def field_examples(dictionary: DataFrame, key: str, n: int, seed: str = "examples") -> DataFrame:
    """n values of each field or attribute."""
    return first_rows(dictionary.select(key, "value").distinct(), [key], n, F.md5(F.concat(F.lit(seed), "value")), F.col("value"))


def shared_values(local: DataFrame, glob: DataFrame) -> DataFrame:
    """(field_id, global_id, value): distinct values in both dictionaries."""
    return local.select("field_id", "value").distinct().join(glob.select("global_id", "value").distinct(), "value").select("field_id", "global_id", "value")


def example_values(cells: DataFrame, seed: str = "value") -> DataFrame:
    """(field_id, value): one value of each field."""
    return cells.groupBy("field_id").agg(random_pick(F.col("value"), seed).alias("value"))


def low_scorers(fields: DataFrame, composed: DataFrame, n: int) -> DataFrame:
    """Fields with the lowest best score; those without any come first."""
    best = composed.groupBy("field_id").agg(F.max("score").alias("score"))
    return fields.join(best, "field_id", "left").select("field_id", "name", F.coalesce("score", F.lit(0.0)).alias("score")).orderBy("score", "field_id").limit(n)


def pairs_to_compare(pairs: DataFrame, target: float | None = None, n: int = 1) -> DataFrame:
    """Unlabelled pairs (e1, e2, sim, human_label): the most alike, or those within 0.05 of a target."""
    open_ = pairs.where("human_label is null")
    near = open_ if target is None else open_.where(F.abs(F.col("sim") - target) <= 0.05)
    return near.orderBy(F.desc("sim"), "e1", "e2").limit(n)


def entity_data(cells: DataFrame, fields: DataFrame, mappings: DataFrame, attributes: DataFrame) -> DataFrame:
    """(entity_id, name, value): cells under the global name of their field, or the local one."""
    named = mappings.join(attributes.select("global_id", F.col("name").alias("global_name")), "global_id").groupBy(F.col("local_id").alias("field_id")).agg(F.min("global_name").alias("global_name"))
    return cells.join(fields.select("field_id", F.col("name").alias("local_name")), "field_id").join(named, "field_id", "left").select("entity_id", F.coalesce("global_name", "local_name").alias("name"), "value")


def compare_entities(data: DataFrame, first: int, second: int) -> DataFrame:
    """(name, value1, value2, both): attributes of two entities, those that both have first."""
    a = data.where(F.col("entity_id") == first).groupBy("name").agg(F.min("value").alias("value1"))
    b = data.where(F.col("entity_id") == second).groupBy("name").agg(F.min("value").alias("value2"))
    out = a.join(b, "name", "full_outer").withColumn("both", F.col("value1").isNotNull() & F.col("value2").isNotNull())
    return out.orderBy(F.desc("both"), "name")


def guess(sim, threshold: float = 0.6):
    return F.when(sim > threshold, "Yes").otherwise("No")


def source_clusters(clustering: DataFrame, entities: DataFrame, titles: DataFrame, source_id: int) -> DataFrame:
    """(cluster_id, entity_id, title): all members of clusters that touch a source; titles (entity_id, title)."""
    touched = clustering.join(entities.where(F.col("source_id") == source_id), "entity_id", "left_semi").select("cluster_id").distinct()
    return clustering.join(touched, "cluster_id", "left_semi").join(titles, "entity_id", "left").select("cluster_id", "entity_id", "title")


def source_simpairs(pairs: DataFrame, clustering: DataFrame, entities: DataFrame, source_id: int) -> DataFrame:
    """(e1, e2, probability): pairs inside one cluster with an end in the source, each once."""
    a = clustering.select(F.col("entity_id").alias("e1"), F.col("cluster_id").alias("c1"))
    b = clustering.select(F.col("entity_id").alias("e2"), F.col("cluster_id").alias("c2"))
    own = entities.where(F.col("source_id") == source_id).select("entity_id").withColumn("own", F.lit(True))
    rows = pairs.join(a, "e1").join(b, "e2").where("c1 = c2")
    rows = rows.join(own.toDF("e1", "own1"), "e1", "left").join(own.toDF("e2", "own2"), "e2", "left").where("own1 or own2")
    return rows.select("e1", "e2", "probability").distinct()


def weak_pairs(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose probability is below a threshold."""
    return pairs.where(F.col("probability") < threshold)
