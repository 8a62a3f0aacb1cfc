"""Queries of ingestion and of scalar, array and aggregate functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import shared_folder
from ..functions import aggregates as agg
from ..functions import numeric, text, tokens
from ..operators.vectors import row_counts
from ..sources import ingest, state
from . import catalog
from .model import s_delimited, table
from .registry import query
from .token_sql import s_stems, s_typed

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


@query("""
SELECT 'supplier/0' AS source, 's_name' AS field, s_suppkey::VARCHAR AS entity, s_name AS value FROM supplier WHERE s_name IS NOT NULL AND s_name <> ''
UNION ALL SELECT 'supplier/0', 's_nationkey', s_suppkey::VARCHAR, s_nationkey::VARCHAR FROM supplier WHERE s_nationkey IS NOT NULL""")
def ingest_unpivot_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.wide_cells(table(spark, sf_dir, "supplier"), "supplier", ["s_name", "s_nationkey"], entity_key="s_suppkey")


_STAGED = "d AS (SELECT event_type AS source_id, event_id AS entity_id, 'props' AS name, props AS value FROM events UNION ALL SELECT event_type, event_id, 'user_id', user_id::VARCHAR FROM events)"


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), F.col("event_id").alias("entity_id"), "props", F.col("user_id").cast("string").alias("user_id"))
    return rows.unpivot(["source_id", "entity_id"], ["props", "user_id"], "name", "value")


@query(f"WITH {_STAGED} SELECT source_id AS source, name AS field, entity_id::VARCHAR AS entity, value FROM d WHERE value IS NOT NULL AND length(value) < 1300")
def ingest_name_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.staged_cells(_staged(spark, sf_dir))


@query(f"""WITH {_STAGED}, c AS (SELECT * FROM d WHERE value IS NOT NULL AND length(value) < 1300)
SELECT count(DISTINCT source_id) AS sources, count(DISTINCT (source_id, name)) AS fields, count(DISTINCT (source_id, entity_id)) AS entities, count(*) AS cells FROM c""")
def ingest_model_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ingest.from_staged(_staged(spark, sf_dir))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(got.sources, "sources").crossJoin(count(got.fields, "fields")).crossJoin(count(got.entities, "entities")).crossJoin(count(got.cells, "cells"))


@query("""WITH s AS (SELECT o_custkey AS source_id, count(*)::BIGINT AS n_values FROM orders GROUP BY 1), i AS (SELECT c_custkey AS source_id FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT source_id, n_values FROM s WHERE source_id NOT IN (SELECT source_id FROM i) AND n_values < 10000000 ORDER BY md5('sources' || source_id::VARCHAR), source_id LIMIT 50""")
def ingest_anti_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source_id")).agg(F.count("*").alias("n_values"))
    return ingest.random_sources(staged, 50, table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("source_id")))


@query("SELECT DISTINCT 1::BIGINT AS att_id, least(p_type, p_brand) AS value_a, greatest(p_type, p_brand) AS value_b FROM part WHERE p_type IS NOT NULL AND p_brand IS NOT NULL")
def ingest_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.synonyms(table(spark, sf_dir, "part"), 1, "p_type", "p_brand")


@query("WITH a(global_id, name) AS (VALUES (1::BIGINT, 'Nation_1'), (2::BIGINT, 'nation_7'), (3::BIGINT, 'other')) SELECT 5::BIGINT AS template_id, global_id AS att_id FROM a WHERE lower(name) IN (SELECT lower(n_name) FROM nation)")
def ingest_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributes = spark.createDataFrame([(1, "Nation_1"), (2, "nation_7"), (3, "other")], "global_id long, name string")
    return ingest.template(table(spark, sf_dir, "nation"), "n_name", 5, attributes)


@query("SELECT DISTINCT p_brand AS name, 'WEB' AS derived_from, 'TEXT' AS type FROM part WHERE p_brand IS NOT NULL")
def ingest_global_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.global_schema(table(spark, sf_dir, "part"), "p_brand").drop("global_id")


@query("""WITH g AS (SELECT p_brand, p_type, p_size::VARCHAR AS p_size, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, unnest(range(1, n + 1)) AS k FROM g),
e AS (SELECT 'part/0' AS source, md5(to_json([p_brand, p_type, p_size])::VARCHAR) || '#' || k AS entity, * FROM r), c AS (SELECT source, 'p_brand' AS field, entity, p_brand AS value FROM e UNION ALL SELECT source, 'p_type', entity, p_type FROM e UNION ALL SELECT source, 'p_size', entity, p_size FROM e)
SELECT * FROM c WHERE value IS NOT NULL AND value <> ''""")
def ingest_without_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without their key: entities by content, and by number among equal parts."""
    return ingest.wide_cells(table(spark, sf_dir, "part").drop("p_partkey"), "part", ["p_brand", "p_type", "p_size"])


@query("""WITH s AS (SELECT user_id AS source_id, count(*)::BIGINT AS n_values FROM events GROUP BY 1), x AS (SELECT source_id FROM s WHERE n_values < 10000000 ORDER BY md5('sources' || source_id::VARCHAR), source_id LIMIT 20)
SELECT user_id::VARCHAR AS source, event_id::VARCHAR AS entity, 'event_type' AS field, event_type AS value FROM events WHERE user_id IN (SELECT source_id FROM x) AND event_type IS NOT NULL AND length(event_type) < 1300""")
def ingest_random_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty staged users, chosen by hash, imported; their cells by natural keys."""
    events = table(spark, sf_dir, "events")
    data = events.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("entity_id"), F.lit("event_type").alias("name"), F.col("event_type").alias("value"))
    got = ingest.import_random(data, data.groupBy("source_id").agg(F.count("*").alias("n_values")), 20)
    rows = got.cells.join(got.sources.withColumnRenamed("local_id", "source"), "source_id").join(got.entities.select("entity_id", F.col("local_id").alias("entity")), "entity_id").join(got.fields.select("field_id", F.col("name").alias("field")), "field_id")
    return rows.select("source", "entity", "field", "value")


@query("WITH a AS (SELECT min(p_partkey)::BIGINT AS global_id, p_type AS name FROM part GROUP BY p_type) SELECT global_id AS att_id, p_brand AS value FROM part JOIN a ON lower(name) = 'promo' WHERE p_brand IS NOT NULL")
def ingest_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All brands as the dictionary of one attribute."""
    return ingest.dictionary(table(spark, sf_dir, "part"), "p_brand", catalog.attributes(spark, sf_dir), "Promo")


@query("""WITH f AS (SELECT DISTINCT p_brand, p_type FROM part) SELECT p_brand AS source, p_type AS field, p_type AS attribute, 1.0::DOUBLE AS confidence FROM f WHERE p_type IS NOT NULL""")
def ingest_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts staged by brand, each type a field tagged with its own name: imported, and mapped to an attribute for each tag."""
    parts = table(spark, sf_dir, "part")
    data = parts.select(F.col("p_brand").alias("source_id"), F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("name"), F.col("p_size").cast("string").alias("value"))
    tagged = parts.select(F.col("p_brand").alias("source_id"), F.col("p_type").alias("name"), F.col("p_type").alias("tag_code")).distinct()
    got, attributes, mapped = ingest.training_load(tagged, data)
    rows = mapped.join(got.fields.select(F.col("field_id").alias("local_id"), "source_id", F.col("name").alias("field")), "local_id").join(got.sources.withColumnRenamed("local_id", "source"), "source_id").join(attributes.select("global_id", F.col("name").alias("attribute")), "global_id")
    return rows.select("source", "field", "attribute", "confidence")


@query("""WITH p AS (SELECT p_partkey AS local_id, p_size AS global_id, p_retailprice / 50.0::DOUBLE AS pct, p_partkey % 3 > 0 AS is_match FROM part)
SELECT local_id::BIGINT AS local_id, global_id::BIGINT AS global_id, CASE WHEN is_match THEN round(pct / 100, 6) END AS confidence, is_match FROM p""")
def crowd_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a user: matches become mappings, others rejections."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("local_id"), F.col("p_size").cast("long").alias("global_id"), (F.col("p_retailprice") / 50.0).alias("pct"), (F.col("p_partkey") % 3 > 0).alias("is_match"))
    mapped, rejected = ingest.answer_rows(rows, 7)
    found = mapped.select("local_id", "global_id", F.round("confidence", 6).alias("confidence"), F.lit(True).alias("is_match"))
    return found.unionByName(rejected.select("local_id", "global_id", F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("is_match")))


@query("""WITH k AS (SELECT n_nationkey::BIGINT AS global_id, n_regionkey::BIGINT + 100 AS new_id FROM nation WHERE n_nationkey % 2 = 0) SELECT c_custkey::BIGINT AS local_id, coalesce(new_id, c_nationkey)::BIGINT AS global_id FROM customer LEFT JOIN k ON global_id = c_nationkey""")
def state_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings moved to new attribute keys; keys without a successor stay."""
    keys = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("global_id"), (F.col("n_regionkey").cast("long") + 100).alias("new_id"))
    return state.rekey(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("local_id"), F.col("c_nationkey").cast("long").alias("global_id")), keys)


@query("""WITH q AS (SELECT doc_id AS e1, doc_id + 1 AS e2 FROM labels), l AS (SELECT DISTINCT doc_id AS e1, doc_id + 1 AS e2, CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS human_label FROM labels WHERE toxic = 0)
SELECT e1, e2, l.human_label FROM q LEFT JOIN l USING (e1, e2)""")
def state_label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in any case set the labels of questions."""
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("e1"), (F.col("doc_id") + 1).alias("e2"), "quality", "toxic")
    answers = rows.where("toxic = 0").select("e1", "e2", F.when(F.col("quality") == 1, "YES").otherwise("no").alias("human_label")).distinct()
    return state.label_pair(rows.select("e1", "e2", F.lit(None).cast("string").alias("human_label")), answers)[0]


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def state_remove_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.lit(1).alias("source_id"), F.col("o_custkey").alias("entity_id"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), "c_nationkey")
    return state.remove_source(rows, own, 1).withColumnRenamed("entity_id", "c_custkey")


#: Tables of each module in a row, with the step that drops them: the modules one by one, "local" by unloading local data.
_STEPS = ("names", "scores", "pairs", "categories", "local", "global")
_DROPPED = {t: _STEPS.index(m if m in _STEPS else "local") for m, names in state.MODULES.items() for t in names}


@query(f"""WITH t(name, number, gone) AS (VALUES {", ".join(f"('{t}', {i}, {gone})" for i, (t, gone) in enumerate(_DROPPED.items()))}), s(step) AS (SELECT unnest(range({len(_STEPS)})))
SELECT step::BIGINT AS step, name, count(*)::BIGINT AS n FROM s JOIN t ON gone > step JOIN orders ON o_orderkey % {len(_DROPPED)} = number GROUP BY ALL""")
def state_clean_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after each clean-up, with its rows: every table holds the orders of one remainder, in a part for each status."""
    store, names = state.StateStore(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"), list(_DROPPED)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % len(names)).alias("number"), "o_orderstatus")
    with store.transaction():
        for i, name in enumerate(names):
            for part in ("F", "other"):
                store.put(name, part, orders.where((F.col("number") == i) & ((F.col("o_orderstatus") == "F") == (part == "F"))))
    left = None
    for step, module in enumerate(_STEPS):
        store.unload_local() if module == "local" else store.clean(module)
        for name in store.manifest():
            rows = store.read(name).agg(F.count("*").alias("n")).select(F.lit(step).cast("long").alias("step"), F.lit(name).alias("name"), "n")
            left = rows if left is None else left.unionByName(rows)
        # The next steps delete folders, so that the counts are written now.
        left = left.checkpoint()
    return left.where("n > 0")


_Q = r"""WITH l AS (SELECT p_partkey AS id, list_filter(string_split_regex(lower(p_name), '\s+'), lambda w: w <> '') AS ws FROM part),
w AS (SELECT id, unnest(ws) AS w, unnest(list_append(ws[2:], NULL)) AS nxt FROM l),
g AS (SELECT id, substr(w, 1, 3) || '!' AS gram FROM w UNION ALL SELECT id, substr(w, 1, 1) || '#' FROM w UNION ALL SELECT id, substr(w, 1, 1) || ' ' || substr(nxt, 1, 1) FROM w WHERE nxt IS NOT NULL
UNION ALL SELECT id, unnest(list_transform(range(1, length(w) - 1), lambda p: substr(w, p, 3))) FROM w WHERE length(w) >= 3)
SELECT id, gram, count(*)::BIGINT AS n FROM g GROUP BY ALL"""


@query(_Q)
def tok_qgrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return row_counts(parts, ["id"], text.qgrams(F.col("p_name")), "gram").withColumnRenamed("c", "n")


@query("SELECT n_nationkey AS id, unnest(list_transform(range(1, length(n_name) + 1), lambda i: substr(n_name, 1, i))) AS prefix FROM nation")
def tok_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.explode(text.prefixes(F.col("n_name"))).alias("prefix"))


@query("SELECT DISTINCT n_nationkey AS id, substr(n_name, i, n) AS piece FROM nation, range(1, 40) a(i), range(1, 40) b(n) WHERE i + n - 1 <= length(n_name)")
def tok_substrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.explode(text.substrings(F.col("n_name"))).alias("piece"))


@query(r"""WITH a AS (SELECT p_partkey AS id, p_name AS t, string_split(p_name, ' ')[2] AS r1 FROM part),
b AS (SELECT id, CASE WHEN instr(lower(t), lower(r1)) > 0 THEN substr(t, 1, instr(lower(t), lower(r1)) - 1) || substr(t, instr(lower(t), lower(r1)) + length(r1)) ELSE t END AS t FROM a)
SELECT id, CASE WHEN instr(lower(t), 'e') > 0 THEN substr(t, 1, instr(lower(t), 'e') - 1) || substr(t, instr(lower(t), 'e') + 1) ELSE t END AS rest FROM b""")
def tok_remove_substrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    removals = F.concat(F.lit("E,"), F.upper(F.split("p_name", " ")[1]))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.remove_substrings(F.col("p_name"), removals).alias("rest"))


@query("SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 're') AND contains(lower(p_name), 'w')")
def tok_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(text.text_filter(F.col("p_name"), F.lit("RE w"))).select(F.col("p_partkey").alias("id"))


def _s_tokens(source: str, text: str) -> str:
    return f"{s_typed('t', source, '', text)}, {s_stems('d', 't')}"


@query(f"WITH {_s_tokens('documents', 'text')} SELECT type::INTEGER AS type, token, count(*)::BIGINT AS n FROM t GROUP BY ALL")
def tok_typed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.inline(tokens.typed_tokens(F.col("text"))))
    return rows.groupBy("type", "token").agg(F.count("*").alias("n"))


@query(f"WITH {_s_tokens('documents', 'text')} SELECT stem, count(*)::BIGINT AS n FROM t JOIN d USING (token) WHERE stem <> '' AND length(token) < 200 GROUP BY ALL")
def tok_stem_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.stems.counts(table(spark, sf_dir, "documents"), [], "text", "stem").withColumnRenamed("c", "n")


@query(f"WITH {_s_tokens('documents', 'text')} SELECT type || '||' || stem AS token, count(*)::BIGINT AS n FROM t JOIN d USING (token) WHERE length(token) < 2048 GROUP BY ALL")
def tok_typed_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.typed_stems.counts(table(spark, sf_dir, "documents"), [], "text", "token").withColumnRenamed("c", "n")


@query(f"""WITH {s_typed('t', 'documents', 'doc_id', 'text')}, {s_stems('d', 't')}, f AS (SELECT doc_id, token FROM t WHERE type = 1 AND length(token) < 100)
SELECT doc_id, stem, count(*)::BIGINT AS n FROM f JOIN d USING (token) WHERE stem <> '' GROUP BY ALL""")
def tok_word_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.word_stems.counts(table(spark, sf_dir, "documents"), ["doc_id"], "text", "stem").withColumnRenamed("c", "n")


@query(f"WITH {_s_tokens('pages', 'html')} SELECT type::INTEGER AS type, stem, count(*)::BIGINT AS n FROM t JOIN d USING (token) GROUP BY ALL")
def tok_page_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, entities, urls and compounds of whole pages."""
    counted = table(spark, sf_dir, "pages").select(F.inline(tokens.typed_tokens(F.col("html")))).groupBy("type", "token").agg(F.count("*").alias("n")).checkpoint()
    return counted.join(tokens.dictionary(counted), "token").groupBy("type", "stem").agg(F.sum("n").alias("n"))


@query(f"WITH RECURSIVE b AS (SELECT DISTINCT p_brand AS t FROM part), {s_delimited('d', 'b', 't')} SELECT t AS p_brand, piece FROM d")
def tok_dsubstrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand").distinct().select("p_brand", F.explode(text.delimited(F.col("p_brand"))).alias("piece"))


@query("""WITH RECURSIVE p AS (SELECT n_name, '' AS parts, n_name AS rest FROM nation UNION ALL
SELECT n_name, parts || CASE WHEN parts = '' THEN '' ELSE '|' END || substr(rest, 1, k), substr(rest, k + 1) FROM p, (SELECT unnest(range(1, 40)) AS k) r WHERE k <= length(rest)) SELECT n_name, parts FROM p WHERE rest = '' AND parts <> ''""")
def tok_strparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.string_partitions(table(spark, sf_dir, "nation"), "n_name").select("n_name", F.array_join("parts", "|").alias("parts"))


@query(rf"""WITH v AS (SELECT event_id AS id, value::DECIMAL(18,2)::VARCHAR AS v FROM events UNION ALL SELECT event_id, props FROM events)
SELECT id, CASE WHEN regexp_matches(v, '{_NUMBER}') THEN TRY_CAST(trim(v) AS DOUBLE) END AS num FROM v""")
def scalar_to_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    v = e.select(F.col("event_id").alias("id"), F.col("value").cast("decimal(18,2)").cast("string").alias("v")).union(e.select("event_id", "props"))
    return v.select("id", numeric.to_num(F.col("v")).alias("num"))


@query("SELECT n_regionkey AS region, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def scalar_group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(agg.group_concat(F.col("n_name"), ";").alias("names"))


@query("SELECT o_orderkey AS id, round(o_totalprice / 7, 2) AS x FROM orders")
def scalar_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), numeric.round_half_up(F.col("o_totalprice") / 7, 2).alias("x"))


@query("SELECT n_regionkey AS region, round(product(1 + n_nationkey / 10.0::DOUBLE), 6) AS p FROM nation GROUP BY 1")
def agg_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.round(F.product(1 + F.col("n_nationkey") / 10.0), 6).alias("p"))


@query("SELECT p_brand AS brand, arg_min(p_name, md5(p_name)) AS name FROM part GROUP BY 1")
def agg_hashmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(agg.hashmin(F.col("p_name")).alias("name"))


@query("SELECT o_orderpriority AS priority, arg_min(o_orderkey, md5('pick' || o_orderkey::VARCHAR)) AS orderkey FROM orders GROUP BY 1")
def agg_random_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(agg.random_pick(F.col("o_orderkey"), "pick").alias("orderkey"))


_SORTED = "a AS (SELECT n_regionkey AS region, list(n_nationkey::DOUBLE ORDER BY n_nationkey) AS v FROM nation GROUP BY 1)"


def _sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list(F.col("n_nationkey").cast("double"))).alias("v"))


@query(f"WITH {_SORTED} SELECT region, unnest(v[1:2]) AS x FROM a")
def arr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(spark, sf_dir).select("region", F.explode(agg.top(F.col("v"), 2)).alias("x"))


@query(f"WITH {_SORTED} SELECT region, v[least(4, len(v))] AS x, v[least(400, len(v))] AS last FROM a")
def arr_kth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(spark, sf_dir).select("region", agg.kth(F.col("v"), 4).alias("x"), agg.kth(F.col("v"), 400).alias("last"))


@query("""WITH r AS (SELECT n_regionkey AS region, n_nationkey::DOUBLE AS x, sum(n_nationkey::DOUBLE) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS s FROM nation)
SELECT region, coalesce(min(CASE WHEN s >= 20 THEN x END), max(x)) AS x FROM r GROUP BY 1""")
def arr_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(spark, sf_dir).select("region", agg.cutoff(F.col("v"), F.lit(20.0)).alias("x"))


@query("""WITH s AS (SELECT event_type AS k, count(value) AS n, avg(value) AS m, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
b AS (SELECT k, hi, greatest(lo, m - 3 * sd) AS f, least(hi, m + 3 * sd) AS t, ceil(sqrt(n))::INTEGER AS nb FROM s WHERE n > 1 AND hi > lo),
r AS (SELECT k, CASE WHEN value < f THEN -1 WHEN value = hi AND t = hi THEN nb - 1 WHEN value >= t THEN nb ELSE least(floor((value - f) / ((t - f) / nb)), nb - 1) END::BIGINT AS bucket FROM events JOIN b ON k = event_type WHERE value IS NOT NULL)
SELECT k AS event_type, bucket, count(*)::BIGINT AS n FROM r GROUP BY ALL""")
def histogram_bucketize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric.histogram(table(spark, sf_dir, "events"), ["event_type"]).select("event_type", "bucket", "n")


@query("SELECT DISTINCT p_size AS size, lpad(lower(to_hex(floor(255 * greatest(0.0, least(1.0, p_size / 40.0)))::BIGINT)), 2, '0') AS color FROM part")
def color_f2c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("size")).distinct().select("size", numeric.color(F.col("size") / 40.0).alias("color"))
