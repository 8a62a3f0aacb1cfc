"""Exploration queries over the curation model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import clustering, compose, explore, mdl
from ..operators import affinity as aff
from . import catalog, model
from .model import S_ATTRIBUTES, S_CELLS, S_FIELDS, s_affinity, table
from .queries_matching import _PIVOT, _RAW, _composite, _raw
from .registry import query

_CLUSTER = "cl AS (SELECT DISTINCT entity_id, entity_id - entity_id % 3 AS cluster_id FROM cells WHERE source_id IN (2, 4))"


def _clustering(cells: DataFrame) -> DataFrame:
    return cells.where("source_id in (2, 4)").select("entity_id", (F.col("entity_id") - F.col("entity_id") % 3).alias("cluster_id")).distinct()


@query(f"""WITH {catalog.S_FIELDS}, {catalog.S_ATTRIBUTES}, {catalog.S_AFFINITY} SELECT source_id, local_id, count(*) AS n_fields, (count(*) FILTER (field_id IN (SELECT mappings.local_id FROM mappings))) AS n_mapped,
round((count(*) FILTER (field_id IN (SELECT mappings.local_id FROM mappings))) / count(*)::DOUBLE, 6) AS ratio FROM fields JOIN src USING (source_id) GROUP BY ALL""")
def explore_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.sources(catalog.sources(spark, sf_dir), catalog.fields(spark, sf_dir), catalog.mappings(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@query("WITH d AS (SELECT o_orderdate AS date_added, count(*) AS sources FROM orders GROUP BY 1) SELECT date_added, sources, row_number() OVER (ORDER BY date_added) AS place FROM d QUALIFY place > (SELECT count(*) FROM d) - 25")
def explore_recent_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.recent_sources(table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("date_added")), 25)


@query(f"""WITH {S_FIELDS}, {S_CELLS}, {s_affinity()}, {_CLUSTER}, e AS (SELECT DISTINCT source_id, entity_id FROM cells), tw AS (SELECT entity_id FROM cl WHERE cluster_id IN (SELECT cluster_id FROM cl GROUP BY 1 HAVING count(*) > 1)),
c AS (SELECT source_id, count(*) AS n_columns, count(*) FILTER (field_id IN (SELECT local_id FROM mappings)) AS n_mapped FROM fields GROUP BY 1), n AS (SELECT source_id, count(*) AS n_entities, count(*) FILTER (entity_id IN (SELECT entity_id FROM tw)) AS n_duplicates FROM e GROUP BY 1)
SELECT source_id, coalesce(n_entities, 0) AS n_entities, n_columns, n_mapped, coalesce(n_duplicates, 0) AS n_duplicates FROM c LEFT JOIN n USING (source_id)""")
def explore_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = model.cells(spark, sf_dir)
    return explore.source_stats(model.fields(spark), cells.select("source_id", "entity_id").distinct(), model.mappings(spark), _clustering(cells))


@query(f"WITH {S_CELLS} SELECT field_id, count(value) AS n_values, count(DISTINCT value) AS n_distinct, round(avg(length(value)), 6) AS avg_val_len, round(1 - count(DISTINCT value) / count(value)::DOUBLE, 6) AS sort_factor FROM cells GROUP BY 1")
def explore_field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.field_profile(model.cells(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("avg_val_len", "sort_factor")})


@query(f"WITH {S_CELLS} SELECT entity_id, coalesce(min(value) FILTER (field_id = 6), '') AS s_suppkey, coalesce(min(value) FILTER (field_id = 7), '') AS s_name, coalesce(min(value) FILTER (field_id = 8), '') AS s_nationkey, coalesce(min(value) FILTER (field_id = 9), '') AS s_acctbal FROM cells WHERE source_id = 2 GROUP BY 1")
def explore_table_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.source_table(model.cells(spark, sf_dir), model.fields(spark), 2)


@query(f"WITH {_RAW} SELECT a.global_id, a.name, round(coalesce(n.score, 0.0), 6)::DOUBLE AS score FROM attributes a LEFT JOIN (SELECT * FROM ncomp WHERE field_id = 16) n ON n.match_id = a.global_id")
def explore_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    composed = _composite(spark, sf_dir)
    return explore.field_candidates(model.attributes(spark), composed, 16).withColumn("score", F.round("score", 6))


@query(f"WITH {catalog.S_FIELDS} SELECT field_id, name FROM fields WHERE lower(name) LIKE '%standard%'")
def explore_fields_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.fields_by_name(catalog.fields(spark, sf_dir), "Standard", False).select("field_id", "name")


@query(f"""WITH {catalog.S_FIELDS}, {catalog.S_ATTRIBUTES}, {catalog.S_AFFINITY}, {catalog.S_REJECTED} SELECT field_id, name FROM fields
WHERE field_id NOT IN (SELECT local_id FROM mappings WHERE who_created = 7) AND field_id NOT IN (SELECT local_id FROM rejected WHERE who_created = 7)""")
def explore_unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.unanswered(catalog.fields(spark, sf_dir), catalog.mappings(spark, sf_dir), catalog.rejections(spark, sf_dir), 7).select("field_id", "name")


@query(f"WITH {S_CELLS}, d AS (SELECT DISTINCT field_id, value FROM cells) SELECT field_id, value FROM d QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY md5('examples' || value), value) <= 3")
def explore_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.field_examples(model.cells(spark, sf_dir), "field_id", 3)


@query(f"""WITH {S_CELLS}, {s_affinity()}, l AS (SELECT DISTINCT field_id, value FROM cells), d AS (SELECT DISTINCT global_id, value FROM cells JOIN affinity ON field_id = local_id WHERE affinity >= 0.5)
SELECT field_id, global_id, value FROM l JOIN d USING (value) WHERE field_id IN (3, 16, 18)""")
def explore_shared_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = mdl.local_dictionary(model.cells(spark, sf_dir))
    glob = mdl.global_dictionary(local, aff.training_mappings(model.mappings(spark)))
    return explore.shared_values(local.where("field_id in (3, 16, 18)"), glob)


@query(f"WITH {S_CELLS} SELECT field_id, arg_min(value, md5('value' || value)) AS value FROM cells GROUP BY 1")
def explore_example_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.example_values(model.cells(spark, sf_dir))


@query(f"WITH {_RAW}, b AS (SELECT field_id, max(score) AS s FROM ncomp GROUP BY 1) SELECT field_id, name, round(coalesce(s, 0.0), 6)::DOUBLE AS score FROM fields LEFT JOIN b USING (field_id) ORDER BY coalesce(s, 0.0), field_id LIMIT 5")
def explore_low_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    composed = _composite(spark, sf_dir)
    return explore.low_scorers(model.fields(spark), composed, 5).withColumn("score", F.round("score", 6))


_DATA = f"{S_FIELDS}, {S_ATTRIBUTES}, {S_CELLS}, {s_affinity()}, nm AS (SELECT local_id AS field_id, min(name) AS g FROM mappings JOIN attributes USING (global_id) GROUP BY 1), dt AS (SELECT entity_id, coalesce(g, name) AS name, value FROM cells JOIN fields USING (field_id) LEFT JOIN nm USING (field_id))"


def _data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.entity_data(model.cells(spark, sf_dir), model.fields(spark), model.mappings(spark), model.attributes(spark))


@query(f"WITH {_DATA} SELECT entity_id, name, value FROM dt")
def explore_entity_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _data(spark, sf_dir)


@query(f"""WITH {_DATA}, a AS (SELECT name, min(value) AS value1 FROM dt WHERE entity_id = 1000000001 GROUP BY 1), b AS (SELECT name, min(value) AS value2 FROM dt WHERE entity_id = 2000000001 GROUP BY 1)
SELECT name, value1, value2, value1 IS NOT NULL AND value2 IS NOT NULL AS "both" FROM a FULL OUTER JOIN b USING (name)""")
def explore_compare_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.compare_entities(_data(spark, sf_dir), model.STEP + 1, 2 * model.STEP + 1)


@query(f"""WITH {S_CELLS}, {_CLUSTER}, tt AS (SELECT entity_id, value AS title FROM cells WHERE field_id IN (7, 17))
SELECT cluster_id, entity_id, title FROM cl LEFT JOIN tt USING (entity_id) WHERE cluster_id IN (SELECT cluster_id FROM cl WHERE entity_id IN (SELECT entity_id FROM cells WHERE source_id = 4))""")
def explore_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = model.cells(spark, sf_dir)
    titles = cells.where("field_id in (7, 17)").select("entity_id", F.col("value").alias("title"))
    return explore.source_clusters(_clustering(cells), cells.select("source_id", "entity_id").distinct(), titles, 4)


_PAIRS = f"{S_CELLS}, {_CLUSTER}, pr AS (SELECT a.entity_id AS e1, b.entity_id AS e2, 0.95::DOUBLE - (b.entity_id - a.entity_id) / 10.0::DOUBLE AS probability FROM cl a JOIN cl b ON b.entity_id > a.entity_id AND b.entity_id <= a.entity_id + 3)"


def _pairs(cells: DataFrame) -> DataFrame:
    """Neighbouring entities of a clustering, with a probability that falls with their distance."""
    own = _clustering(cells)
    left = own.select(F.col("entity_id").alias("e1"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("gap")).withColumn("e2", F.col("e1") + F.col("gap"))
    return left.join(own.select(F.col("entity_id").alias("e2")), "e2", "left_semi").select("e1", "e2", (F.lit(0.95) - F.col("gap") / 10.0).alias("probability"))


@query(f"""WITH {_PAIRS} SELECT e1, e2, round(probability, 6) AS probability FROM pr JOIN cl a ON a.entity_id = e1 JOIN cl b ON b.entity_id = e2 WHERE a.cluster_id = b.cluster_id
AND (e1 IN (SELECT entity_id FROM cells WHERE source_id = 2) OR e2 IN (SELECT entity_id FROM cells WHERE source_id = 2))""")
def explore_simpairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = model.cells(spark, sf_dir)
    return explore.source_simpairs(_pairs(cells), _clustering(cells), cells.select("source_id", "entity_id").distinct(), 2).withColumn("probability", F.round("probability", 6))


@query(f"WITH {_PAIRS} SELECT e1, e2, round(probability, 6) AS sim FROM pr WHERE e1 % 2 = 0 AND round(abs(probability - 0.75), 6) <= 0.05 ORDER BY round(probability, 6) DESC, e1, e2 LIMIT 20")
def explore_pairs_to_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(model.cells(spark, sf_dir)).select("e1", "e2", F.round("probability", 6).alias("sim"), F.when(F.col("e1") % 2 == 1, "Yes").alias("human_label"))
    return explore.pairs_to_compare(rows, 0.75, 20).select("e1", "e2", "sim")


@query(f"WITH {_PAIRS} SELECT e1, e2, round(probability, 6) AS probability FROM pr WHERE probability < 0.8")
def explore_weak_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.weak_pairs(_pairs(model.cells(spark, sf_dir)), 0.8).withColumn("probability", F.round("probability", 6))


@query(f"WITH {S_CELLS}, {_CLUSTER} SELECT cluster_id, count(*) AS size FROM cl GROUP BY 1")
def explore_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_size(_clustering(model.cells(spark, sf_dir)))


@query(f"WITH {S_CELLS}, e AS (SELECT DISTINCT entity_id FROM cells WHERE source_id = 4 ORDER BY md5('entities' || entity_id::VARCHAR), entity_id LIMIT 10) SELECT entity_id, count(*) AS n FROM cells WHERE source_id = 4 AND entity_id IN (SELECT entity_id FROM e) GROUP BY 1")
def explore_source_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.source_entities(model.cells(spark, sf_dir), 4, 10).select("entity_id", F.size("cells").cast("long").alias("n"))


@query(f"WITH {catalog.S_SOURCES} SELECT source_id, local_id FROM src ORDER BY source_id LIMIT 3")
def explore_source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.source_list(catalog.sources(spark, sf_dir), 3)


@query(f"WITH {catalog.S_SOURCES} SELECT local_id FROM src WHERE source_id = 2")
def explore_source_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.source_name(catalog.sources(spark, sf_dir), 2)


@query(f"WITH {catalog.S_ATTRIBUTES} SELECT global_id, name FROM attributes")
def explore_global_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.global_attributes(catalog.attributes(spark, sf_dir))


@query(f"""WITH {S_CELLS}, {S_FIELDS}, pr AS (SELECT field_id, count(value) AS n_values, round(1 - count(DISTINCT value) / count(value)::DOUBLE, 2) AS f, avg(length(value)) AS l FROM cells GROUP BY 1)
SELECT field_id, name, row_number() OVER (ORDER BY f, l, field_id) AS place FROM fields JOIN pr USING (field_id) WHERE source_id = 3""")
def explore_source_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explore.source_fields(model.fields(spark), explore.field_profile(model.cells(spark, sf_dir)), 3)
    order = Window.orderBy(F.round("sort_factor", 2), "avg_val_len", "field_id")
    return rows.select("field_id", "name", F.row_number().over(order).cast("long").alias("place"))


@query(f"""WITH {_RAW}, top AS (SELECT field_id, arg_min(match_id, (-score, match_id)) AS m FROM ncomp GROUP BY 1), mp AS (SELECT local_id, min(global_id) AS g FROM mappings GROUP BY 1)
SELECT f.field_id, f.name, coalesce(g, m) AS match_id FROM fields f LEFT JOIN top USING (field_id) LEFT JOIN mp ON local_id = f.field_id WHERE lower(f.name) LIKE '%nation%'""")
def explore_mappings_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compose.field_mappings(model.fields(spark), model.attributes(spark), model.mappings(spark), _composite(spark, sf_dir))
    return explore.mappings_by_name(model.fields(spark), found, "Nation", False).select("field_id", "name", "match_id")


@query(f"WITH {_RAW} SELECT field_id, match_id, {_PIVOT}, round(sum(score * score), 6)::DOUBLE AS composite FROM raw GROUP BY ALL")
def explore_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.scores_with_composite(_raw(spark, sf_dir), compose.default_methods(spark)).withColumn("composite", F.round("composite", 6))


@query(f"""WITH {_RAW}, {S_CELLS}, pr AS (SELECT field_id, count(value) AS n_values, count(DISTINCT value) AS n_distinct FROM cells WHERE field_id = 16 GROUP BY 1),
sc AS (SELECT field_id, match_id, {_PIVOT}, round(sum(score * score), 6)::DOUBLE AS composite FROM raw WHERE field_id = 16 AND match_id = 2 GROUP BY ALL)
SELECT pr.field_id, n_values, n_distinct, match_id, qgrams, mdl, ngrams, dist, composite,
(SELECT count(*) FROM (SELECT DISTINCT value FROM cells WHERE field_id = 16 INTERSECT SELECT DISTINCT value FROM cells JOIN affinity ON field_id = local_id WHERE global_id = 2)) AS n_shared FROM pr LEFT JOIN sc USING (field_id)""")
def explore_field_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = model.cells(spark, sf_dir)
    local = mdl.local_dictionary(cells)
    scores = compose.scores_with_composite(_raw(spark, sf_dir), compose.default_methods(spark)).withColumn("composite", F.round("composite", 6))
    rows = explore.field_detail(16, 2, explore.field_profile(cells), local, mdl.global_dictionary(local, aff.affinities(model.mappings(spark))), scores)
    return rows.drop("avg_val_len", "sort_factor")


@query("SELECT n_nationkey::BIGINT AS source_id, n_name AS meta_name, n_regionkey::VARCHAR AS value FROM nation WHERE n_nationkey = 3")
def explore_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("source_id"), F.col("n_name").alias("meta_name"), F.col("n_regionkey").cast("string").alias("value"))
    return explore.meta(rows, "source_id", 3)
