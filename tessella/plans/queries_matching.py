"""Queries of affinities, the four matchers, their composition and its evaluation."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import settle, shared_folder
from ..functions.aggregates import rank_first
from ..operators import affinity as aff
from ..operators import compose, deltas, distributions, mapping, mdl, meta_tree, name_qgrams, value_tokens
from ..operators.vectors import term_counts
from ..sources.state import StateStore
from . import catalog, model
from .model import MAPPINGS, S_ATTRIBUTES, S_CELLS, S_FIELDS, SURE, s_affinity, s_grams, s_words
from .registry import query
from .token_sql import s_stems, s_typed


_CATALOG = f"{catalog.S_FIELDS}, {catalog.S_ATTRIBUTES}, {catalog.S_AFFINITY}"


@query(f"WITH {_CATALOG} SELECT local_id, global_id, round(affinity, 6) AS affinity FROM affinity")
def affinity_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aff.affinities(catalog.mappings(spark, sf_dir)).withColumn("affinity", F.round("affinity", 6))


@query(f"WITH {_CATALOG} SELECT local_id, global_id, round(affinity, 6) AS affinity FROM affinity a WHERE affinity = (SELECT max(affinity) FROM affinity b WHERE b.local_id = a.local_id)")
def affinity_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aff.max_affinities(catalog.mappings(spark, sf_dir)).withColumn("affinity", F.round("affinity", 6))


@query(f"WITH {_CATALOG} SELECT local_id, global_id, round(affinity, 6) AS affinity FROM affinity WHERE affinity >= 0.5")
def training_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aff.training_mappings(catalog.mappings(spark, sf_dir)).withColumn("affinity", F.round("affinity", 6))


def _model_sql(rows=MAPPINGS) -> str:
    return f"{S_FIELDS}, {S_ATTRIBUTES}, {s_affinity(rows)}"


def _name_sql(known: str) -> str:
    return (
        f"{known}, {s_grams('lg', 'fields', 'source_id field_id', 'name')}, {s_grams('ag', 'attributes', 'global_id', 'name')}, "
        "l AS (SELECT source_id, field_id, gram, count(*)::BIGINT AS c, ln(1 + count(*)) AS tf FROM lg GROUP BY ALL), "
        "gm AS (SELECT global_id, gram, sum(c * affinity) AS c FROM l JOIN affinity ON field_id = local_id GROUP BY ALL), own AS (SELECT global_id, gram, count(*)::DOUBLE AS c FROM ag GROUP BY ALL), "
        "g AS (SELECT *, ln(1 + c) AS tf FROM (SELECT * FROM gm UNION ALL SELECT * FROM own WHERE NOT EXISTS (SELECT 1 FROM gm WHERE gm.global_id = own.global_id AND gm.gram = own.gram))), "
        "df AS (SELECT gram, count(*) AS df FROM g GROUP BY 1), voc AS (SELECT gram FROM l UNION SELECT gram FROM g), "
        "idf AS (SELECT gram, sqrt(ln((SELECT count(*) FROM attributes) / coalesce(df, 1)::DOUBLE)) AS idf FROM voc LEFT JOIN df USING (gram)), "
        "lw AS (SELECT source_id, field_id, gram, tf * idf AS w FROM l JOIN idf USING (gram)), gw AS (SELECT global_id, gram, tf * idf AS w FROM g JOIN idf USING (gram)), "
        "ln_ AS (SELECT field_id, sqrt(sum(w * w)) AS nl FROM lw GROUP BY 1), gn AS (SELECT global_id, sqrt(sum(w * w)) AS nr FROM gw GROUP BY 1), "
        "cs AS (SELECT field_id, global_id, sum(lw.w * gw.w) / (any_value(nl) * any_value(nr)) AS score FROM lw JOIN gw USING (gram) JOIN ln_ USING (field_id) JOIN gn USING (global_id) WHERE nl > 0 AND nr > 0 GROUP BY ALL)"
    )


@query(f"WITH {_name_sql(_CATALOG)} SELECT source_id, field_id, gram, c, round(tf, 6) AS tf FROM l")
def name_qgrams_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_qgrams.local_grams(catalog.fields(spark, sf_dir)).withColumn("tf", F.round("tf", 6))


@query(f"WITH {_name_sql(_CATALOG)} SELECT global_id, gram, round(c, 6) AS c, round(tf, 6) AS tf FROM g")
def name_qgrams_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = name_qgrams.global_grams(name_qgrams.local_grams(catalog.fields(spark, sf_dir)), catalog.attributes(spark, sf_dir), _affinity(spark, sf_dir))
    return rows.select("global_id", "gram", F.round("c", 6).alias("c"), F.round("tf", 6).alias("tf"))


@query(f"WITH {_name_sql(_CATALOG)} SELECT gram, round(idf, 6) AS idf FROM idf")
def name_qgrams_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = name_qgrams.local_grams(catalog.fields(spark, sf_dir))
    glob = name_qgrams.global_grams(local, catalog.attributes(spark, sf_dir), _affinity(spark, sf_dir))
    return name_qgrams.gram_idf(local, glob, catalog.attributes(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


def _affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aff.affinities(catalog.mappings(spark, sf_dir))


def _names(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    return name_qgrams.scores(catalog.fields(spark, sf_dir), catalog.attributes(spark, sf_dir), _affinity(spark, sf_dir), wanted)


@query(f"WITH {_name_sql(_CATALOG)} SELECT field_id, global_id, round(score, 6) AS score FROM cs")
def name_qgrams_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"WITH {_name_sql(_CATALOG)} SELECT field_id, global_id, round(score, 6) AS score FROM cs WHERE field_id NOT IN (SELECT local_id FROM mappings)")
def name_qgrams_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir, mapping.chosen_fields(catalog.fields(spark, sf_dir), catalog.mappings(spark, sf_dir))).withColumn("score", F.round("score", 6))


@query(f"WITH {_name_sql(_CATALOG)} SELECT field_id, global_id, round(score, 6) AS score FROM cs WHERE field_id IN (SELECT field_id FROM fields WHERE source_id < 10 AND name LIKE '%standard%')")
def name_qgrams_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir, mapping.chosen_fields(catalog.fields(spark, sf_dir), predicate="source_id < 10 and name like '%standard%'")).withColumn("score", F.round("score", 6))


def _stem_source(out: str, source: str, keys: str, text: str) -> str:
    """CTE out(keys, token): type number, two bars and stem of each token."""
    k = ", ".join(keys.split())
    return f"{s_typed(out + '_t', source, keys, text)}, {s_stems(out + '_s', out + '_t')}, {out} AS (SELECT {k}, type || '||' || stem AS token FROM {out}_t JOIN {out}_s USING (token) WHERE length(token) < 2048)"


def _token_sql(tokens=s_words) -> str:
    return (
        f"{S_FIELDS}, {S_ATTRIBUTES}, {S_CELLS}, {s_affinity()}, dict AS (SELECT 6::BIGINT AS global_id, p_type AS value FROM part UNION ALL SELECT 1::BIGINT, n_name FROM nation), "
        f"{tokens('lt', 'cells', 'source_id field_id', 'value')}, {tokens('dt', 'dict', 'global_id', 'value')}, "
        "l0 AS (SELECT source_id, field_id, token AS gram, count(*)::BIGINT AS c FROM lt GROUP BY ALL), l AS (SELECT *, c / sum(c) OVER (PARTITION BY field_id)::DOUBLE AS tf FROM l0), "
        "g0 AS (SELECT global_id, gram, c * affinity AS c FROM l JOIN affinity ON field_id = local_id UNION ALL SELECT global_id, token, count(*)::DOUBLE FROM dt GROUP BY ALL), "
        "g1 AS (SELECT global_id, gram, sum(c) AS c FROM g0 GROUP BY ALL), g AS (SELECT *, c / sum(c) OVER (PARTITION BY global_id) AS tf FROM g1), "
        "idf AS (SELECT gram, sqrt(ln((SELECT count(*) FROM attributes) / count(*)::DOUBLE)) AS idf FROM g GROUP BY 1), "
        "lw AS (SELECT field_id, gram, tf * idf AS w FROM l JOIN idf USING (gram)), gw AS (SELECT global_id, gram, tf * idf AS w FROM g JOIN idf USING (gram)), "
        "ln_ AS (SELECT field_id, sqrt(sum(w * w)) AS nl FROM lw GROUP BY 1), gn AS (SELECT global_id, sqrt(sum(w * w)) AS nr FROM gw GROUP BY 1), "
        "cs AS (SELECT field_id, global_id, sum(lw.w * gw.w) / (any_value(nl) * any_value(nr)) AS score FROM lw JOIN gw USING (gram) JOIN ln_ USING (field_id) JOIN gn USING (global_id) WHERE nl > 0 AND nr > 0 GROUP BY ALL)"
    )


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = model.table(spark, sf_dir, "part").select(F.lit(6).cast("long").alias("global_id"), F.col("p_type").alias("value"))
    return types.union(model.table(spark, sf_dir, "nation").select(F.lit(1).cast("long"), "n_name"))


@query(f"WITH {_token_sql()} SELECT source_id, field_id, gram, c, round(tf, 6) AS tf FROM l")
def value_tokens_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_tokens.local_tokens(model.cells(spark, sf_dir), value_tokens.words).withColumn("tf", F.round("tf", 6))


@query(f"WITH {_token_sql()} SELECT gram, round(idf, 6) AS idf FROM idf")
def value_tokens_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = value_tokens.local_tokens(model.cells(spark, sf_dir), value_tokens.words)
    glob = value_tokens.global_tokens(local, _dictionary(spark, sf_dir), model.affinity(spark), value_tokens.words)
    return value_tokens.token_idf(glob, model.attributes(spark)).withColumn("idf", F.round("idf", 6))


def _tokens(spark: SparkSession, sf_dir: str, tokenizer=value_tokens.words) -> DataFrame:
    return value_tokens.scores(model.cells(spark, sf_dir), _dictionary(spark, sf_dir), model.attributes(spark), model.affinity(spark), tokenizer)


@query(f"WITH {_token_sql()} SELECT field_id, global_id, round(score, 6) AS score FROM cs")
def value_tokens_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"WITH {_token_sql(_stem_source)} SELECT field_id, global_id, round(score, 6) AS score FROM cs")
def value_tokens_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, value_tokens.typed_stems).withColumn("score", F.round("score", 6))


#: Without affinities: local values ml, statistics st, dictionary d, its cards cl, matches m and terms t.
_MDL = (
    f"{S_CELLS}, training AS (SELECT * FROM affinity WHERE affinity >= 0.5), ml AS (SELECT source_id, field_id, substr(value, 1, 1000) AS value, count(*)::BIGINT AS c FROM cells GROUP BY ALL), "
    "st AS (SELECT field_id, sum(c)::BIGINT AS n, sum(length(value) * c) / sum(c)::DOUBLE AS avglen, max(length(value))::BIGINT AS maxlen FROM ml GROUP BY 1), "
    "d AS (SELECT global_id, value, least(1.0, sum(affinity))::DOUBLE AS affinity FROM ml JOIN training ON field_id = local_id GROUP BY ALL), "
    "cl AS (SELECT global_id, length(value)::INTEGER AS len, sum(affinity) AS card, log2(sum(affinity)) AS lg_card FROM d GROUP BY ALL), "
    "m AS (SELECT field_id, global_id, length(value)::INTEGER AS len, sum(c * affinity) AS card, log2(sum(c * affinity)) AS lg_card FROM ml JOIN d USING (value) GROUP BY ALL), "
    "j AS (SELECT m.field_id, m.global_id, sum(m.card) / count(*) / any_value(n) AS f, sum(m.lg_card + cl.lg_card) AS s, any_value(n) AS n, any_value(avglen) AS avglen, any_value(maxlen) AS maxlen FROM m JOIN cl USING (global_id) JOIN st ON st.field_id = m.field_id GROUP BY ALL), "
    "t AS (SELECT field_id, global_id, n, avglen, maxlen, f, f * log2(maxlen) AS term1, (1 - f) * 8 * avglen AS term2, f / n * s AS term3 FROM j)"
)


def _mdl_sql() -> str:
    return f"{s_affinity()}, {_MDL}"


@query(f"WITH {_mdl_sql()} SELECT source_id, field_id, value, c FROM ml")
def mdl_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mdl.local_dictionary(model.cells(spark, sf_dir))


@query(f"WITH {_mdl_sql()} SELECT field_id, n, round(avglen, 6) AS avglen, maxlen, round(8 * avglen, 6) AS base FROM st")
def mdl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = mdl.input_stats(mdl.local_dictionary(model.cells(spark, sf_dir)))
    return stats.join(mdl.base_length(stats), "field_id").select("field_id", "n", F.round("avglen", 6).alias("avglen"), "maxlen", F.round("dl", 6).alias("base"))


def _mdl(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    local = mdl.local_dictionary(model.cells(spark, sf_dir))
    return local, mdl.global_dictionary(local, aff.training_mappings(model.mappings(spark)))


@query(f"WITH {_mdl_sql()} SELECT global_id, len, round(card, 6) AS card, round(lg_card, 6) AS lg_card FROM cl")
def mdl_card_by_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mdl.cards_by_length(_mdl(spark, sf_dir)[1]).select("global_id", "len", F.round("card", 6).alias("card"), F.round("lg_card", 6).alias("lg_card"))


@query(f"WITH {_mdl_sql()} SELECT field_id, global_id, len, round(card, 6) AS card, round(lg_card, 6) AS lg_card FROM m")
def mdl_matches_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mdl.matches(*_mdl(spark, sf_dir)).select("field_id", "global_id", "len", F.round("card", 6).alias("card"), F.round("lg_card", 6).alias("lg_card"))


@query(f"WITH {_mdl_sql()} SELECT field_id, global_id, round(f, 6) AS f, round(term1, 6) AS term1, round(term2, 6) AS term2, round(term3, 6) AS term3 FROM t")
def mdl_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mdl.description_length(*_mdl(spark, sf_dir))
    return rows.select("field_id", "global_id", *[F.round(c, 6).alias(c) for c in ("f", "term1", "term2", "term3")])


@query(f"WITH {_mdl_sql()} SELECT field_id, global_id, round(greatest(0.0, 1 - (term1 + term2 + term3) / (8 * avglen)), 6) AS score FROM t")
def mdl_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mdl.scores(*_mdl(spark, sf_dir)).withColumn("score", F.round("score", 6))


_DIST = rf"""{S_CELLS}, {s_affinity()}, x AS (SELECT field_id, TRY_CAST(value AS DOUBLE) AS x FROM cells WHERE regexp_matches(value, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$')),
s AS (SELECT field_id, count(*)::BIGINT AS n, avg(x) AS mean, var_samp(x) AS variance FROM x GROUP BY 1 HAVING count(*) > 1),
g AS (SELECT global_id, field_id, n, mean, variance, affinity FROM s JOIN affinity ON field_id = local_id)"""


@query(f"WITH {_DIST} SELECT field_id, n, round(mean, 4) AS mean, round(variance, 3) AS variance FROM s")
def dist_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.moments(model.cells(spark, sf_dir)).select("field_id", "n", F.round("mean", 4).alias("mean"), F.round("variance", 3).alias("variance"))


@query(f"WITH {_DIST} SELECT field_id, count(*)::BIGINT AS n, round(sum(x), 2) AS sum_x FROM x GROUP BY 1")
def dist_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.sums(model.cells(spark, sf_dir)).select("field_id", "n", F.round("sum_x", 2).alias("sum_x"))


@query(f"""WITH {_DIST}, q AS (SELECT s.field_id, g.global_id, g.field_id AS mapped, s.variance / s.n AS s1, g.variance / g.n AS s2, s.n AS n1, g.n AS n2, abs(s.mean - g.mean) AS d FROM s, g WHERE s.variance > 0 AND g.variance > 0)
SELECT field_id, global_id, mapped, round(d / sqrt(s1 + s2), 5) AS t, round((s1 + s2) ** 2 / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)), 4) AS df FROM q""")
def dist_welch_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = distributions.moments(model.cells(spark, sf_dir))
    rows = distributions.welch(stats, distributions.global_moments(stats, model.affinity(spark)))
    return rows.select("field_id", "global_id", "mapped", F.round("t", 5).alias("t"), F.round("df", 4).alias("df"))


#: Two-sided p-values in SQL: one less twice the integral of Student's density from 0 to t, by Simpson's rule on 2000 steps.
_P_VALUES = f"""{_DIST}, q AS (SELECT s.field_id, g.global_id, g.affinity, s.variance / s.n AS s1, g.variance / g.n AS s2, s.n AS n1, g.n AS n2, abs(s.mean - g.mean) AS d FROM s, g WHERE s.variance > 0 AND g.variance > 0),
w AS (SELECT row_number() OVER () AS id, field_id, global_id, affinity, d / sqrt(s1 + s2) AS t, (s1 + s2) ** 2 / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)) AS v FROM q),
i AS (SELECT id, sum((CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-(v + 1) / 2 * ln(1 + (least(t, 40) * k / 2000.0::DOUBLE) ** 2 / v))) * any_value(least(t, 40)) / 6000.0::DOUBLE AS area FROM w, range(2001) r(k) GROUP BY id),
p AS (SELECT field_id, global_id, affinity, greatest(0.0, 1 - 2 * area * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi())) AS p FROM w JOIN i USING (id)),
ds AS (SELECT field_id, global_id, max(p * affinity) AS score FROM p WHERE p > 0 GROUP BY ALL)"""


@query(f"WITH {_P_VALUES} SELECT field_id, global_id, round(score, 6) AS score FROM ds WHERE round(score, 6) > 0")
def dist_pvalue_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.scores(model.cells(spark, sf_dir), model.affinity(spark)).withColumn("score", F.round("score", 6)).where("score > 0")


#: Quantities of each supplier's lines against those of each part size's lines, mapped with an affinity by size.
_FLOOR = 0.3
_S_SUPPLY = "s AS (SELECT l_suppkey AS field_id, count(*) AS n, avg(l_quantity::DOUBLE) AS mean, var_samp(l_quantity::DOUBLE) AS variance FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1 HAVING count(*) > 1), g AS (SELECT l_partkey % 97 AS global_id, count(*) AS n, avg(l_quantity::DOUBLE) AS mean, var_samp(l_quantity::DOUBLE) AS variance, (1 + l_partkey % 97 % 5) / 5.0::DOUBLE AS affinity FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY l_partkey % 97 HAVING count(*) > 1)"


@query(f"WITH {_S_SUPPLY}{_P_VALUES[len(_DIST):]} SELECT field_id::BIGINT AS field_id, global_id::BIGINT AS global_id, round(score, 5) AS score FROM ds WHERE round(score, 5) >= {_FLOOR}")
def dist_scores_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by intervals of their means: suppliers are fields, groups of parts the mapped ones."""
    lines = model.table(spark, sf_dir, "lineitem").where("l_quantity is not null").select(F.col("l_suppkey").cast("long").alias("field_id"), (F.col("l_partkey") % 97).cast("long").alias("global_id"), F.col("l_quantity").cast("string").alias("value"))
    stats = distributions.moments(lines.select("field_id", "value"))
    groups = distributions.moments(lines.select(F.col("global_id").alias("field_id"), "value"))
    glob = groups.withColumn("affinity", (1 + F.col("field_id") % 5) / 5.0).withColumnRenamed("field_id", "global_id")
    # Rounded scores are held against the floor, as in SQL.
    return distributions.scores_above(stats, glob, _FLOOR - 1e-5).withColumn("score", F.round("score", 5)).where(F.col("score") >= _FLOOR)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded scores of the four matchers as one table of results."""
    cells = model.cells(spark, sf_dir)
    scored = {"qgrams": name_qgrams.scores(model.fields(spark), model.attributes(spark), model.affinity(spark)), "mdl": mdl.scores(*_mdl(spark, sf_dir)), "ngrams": _tokens(spark, sf_dir), "dist": distributions.scores(cells, model.affinity(spark))}
    rows = compose.raw_results(model.fields(spark), **{k: v.withColumn("score", F.round("score", 6)) for k, v in scored.items()})
    return rows.where("method_name <> 'dist' or score > 0")


_RAW = (
    f"{S_FIELDS}, {S_ATTRIBUTES}, {s_affinity(MAPPINGS)}, "
    f"m_qgrams AS (WITH {_name_sql(_model_sql(MAPPINGS))} SELECT field_id, global_id, score FROM cs), "
    f"m_mdl AS (WITH {_mdl_sql()} SELECT field_id, global_id, greatest(0.0, 1 - (term1 + term2 + term3) / (8 * avglen)) AS score FROM t), "
    f"m_ngrams AS (WITH {_token_sql()} SELECT field_id, global_id, score FROM cs), m_dist AS (WITH {_P_VALUES} SELECT field_id, global_id, score FROM ds WHERE round(score, 6) > 0), "
    "raw AS (" + " UNION ALL ".join(f"SELECT source_id, field_id, '{m}' AS method_name, global_id AS match_id, round(score, 6) AS score FROM m_{m} JOIN fields USING (field_id)" for m in compose.METHODS) + "), "
    "best AS (SELECT * FROM raw r WHERE score = (SELECT max(score) FROM raw q WHERE q.field_id = r.field_id AND q.method_name = r.method_name)), "
    "ncomp AS (SELECT source_id, field_id, match_id, round(sum(score * score), 9) AS score FROM raw GROUP BY ALL), "
    "nmax AS (SELECT * FROM ncomp a WHERE score = (SELECT max(score) FROM ncomp b WHERE b.field_id = a.field_id)), "
    "mcomp AS (SELECT source_id, field_id, match_id, count(*)::DOUBLE AS score FROM best GROUP BY ALL)"
)


def _composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite scores, rounded so that sums in any order tie alike."""
    return compose.composite(_raw(spark, sf_dir), compose.default_methods(spark)).withColumn("score", F.round("score", 9))


@query(f"WITH {_RAW} SELECT source_id, field_id, method_name, match_id, score FROM best")
def raw_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.raw_max(_raw(spark, sf_dir))


@query(f"WITH {_RAW} SELECT source_id, field_id, match_id, round(score, 6) AS score FROM ncomp")
def ncomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _composite(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"WITH {_RAW} SELECT source_id, field_id, match_id, round(score, 6) AS score FROM nmax")
def ncomp_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_first(_composite(spark, sf_dir), ["field_id"], F.desc("score")).withColumn("score", F.round("score", 6))


@query(f"WITH {_RAW} SELECT source_id, field_id, match_id, score FROM mcomp")
def mcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.votes(_raw(spark, sf_dir), compose.default_methods(spark))


@query(f"WITH {_RAW} SELECT source_id, field_id, match_id, score FROM mcomp a WHERE score = (SELECT max(score) FROM mcomp b WHERE b.field_id = a.field_id)")
def mcomp_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.votes_max(_raw(spark, sf_dir), compose.default_methods(spark))


@query(f"""WITH {_RAW}, top AS (SELECT field_id, arg_min(match_id, (-score, match_id)) AS m, max(score) AS s FROM ncomp GROUP BY 1), mp AS (SELECT local_id, min(global_id) AS g FROM mappings GROUP BY 1)
SELECT f.field_id, f.name, coalesce(g, m) AS match_id, coalesce(a.name, b.name, 'Unknown') AS match_name, round(CASE WHEN g IS NOT NULL THEN 2.0 ELSE coalesce(s, 0.0) END::DOUBLE, 6) AS score, g IS NOT NULL AS mapped
FROM fields f LEFT JOIN top USING (field_id) LEFT JOIN mp ON local_id = f.field_id LEFT JOIN attributes a ON a.global_id = g LEFT JOIN attributes b ON b.global_id = m""")
def field_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    composed = _composite(spark, sf_dir)
    return compose.field_mappings(model.fields(spark), model.attributes(spark), model.mappings(spark), composed).drop("candidates").withColumn("score", F.round("score", 6))


@query(f"""WITH {_RAW} SELECT field_id AS local_id, arg_min(match_id, (-score, match_id)) AS global_id, 1.0::DOUBLE AS confidence, 1.0::DOUBLE AS authority, (-2)::BIGINT AS who_created, 'AUTO' AS why_created
FROM ncomp WHERE score >= 0.2 AND field_id NOT IN (SELECT local_id FROM mappings) GROUP BY field_id""")
def auto_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    composed = _composite(spark, sf_dir)
    return compose.auto_accept(model.fields(spark), model.mappings(spark), composed, 0.2)


_PIVOT = ", ".join(f"coalesce(max(CASE WHEN method_name = '{m}' THEN score END), 0.0)::DOUBLE AS {m}" for m in compose.METHODS)


@query(f"WITH {_RAW} SELECT field_id, match_id, {_PIVOT} FROM raw GROUP BY ALL")
def score_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.score_pivot(_raw(spark, sf_dir))


#: Gold attributes of fields; null is no truth.
_GOLD = ((2, 1), (3, 2), (4, 3), (5, 4), (11, 1), (12, 5), (13, 6), (14, 7), (15, 8), (16, 2), (17, 1), (18, 9))


def _gold(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*_GOLD, (1, None)], "field_id long, tag_id long")


_S_GOLD = "gold(field_id, tag_id) AS (VALUES " + ", ".join(f"({a}::BIGINT, {b}::BIGINT)" for a, b in _GOLD) + ", (1::BIGINT, NULL))"


@query(f"""WITH {_RAW}, {_S_GOLD}, h AS (SELECT method_name, match_id = tag_id AS hit FROM best JOIN gold USING (field_id))
SELECT method_name, count(*) FILTER (hit) AS correct, count(*) FILTER (NOT hit) AS wrong, count(*) FILTER (hit IS NULL) AS null_truth, count(*) AS total,
count(*) FILTER (hit) / nullif(count(*) FILTER (hit IS NOT NULL), 0)::DOUBLE AS success_rate, count(*) FILTER (NOT hit) / nullif(count(*) FILTER (hit IS NOT NULL), 0)::DOUBLE AS error_rate FROM h GROUP BY 1""")
def accuracy_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.accuracy(compose.raw_max(_raw(spark, sf_dir)), _gold(spark), ["method_name"])


_TRIALS = tuple((t, m, w) for t, ws in enumerate(((1.0, 0.2, 0.5, 0.1), (0.1, 1.0, 0.3, 0.7), (0.25, 0.25, 1.0, 0.0)), 1) for m, w in zip(compose.METHODS, ws, strict=True))


@query(f"""WITH {_RAW}, {_S_GOLD}, w(trial, method_name, weight) AS (VALUES {", ".join(f"({t}::BIGINT, '{m}', {w}::DOUBLE)" for t, m, w in _TRIALS)}),
c AS (SELECT trial, field_id, match_id, round(sum((score * weight) ** 2), 9) AS s FROM raw JOIN w USING (method_name) GROUP BY ALL), b AS (SELECT trial, field_id, arg_min(match_id, (-s, match_id)) AS m FROM c GROUP BY ALL)
SELECT trial, count(*) FILTER (m = tag_id) AS correct, count(*) AS total FROM b JOIN gold USING (field_id) WHERE tag_id IS NOT NULL GROUP BY 1""")
def weight_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.weight_search(_raw(spark, sf_dir), _gold(spark), spark.createDataFrame(_TRIALS, "trial long, method_name string, weight double"))


@query()
def weight_search_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.weight_search(_raw(spark, sf_dir), _gold(spark), compose.random_weights(spark, 50))


_HITS = "count(*) FILTER (hit) AS correct, count(*) FILTER (NOT hit) AS wrong, count(*) FILTER (hit IS NULL) AS null_truth, count(*) AS total, count(*) FILTER (hit) / nullif(count(*) FILTER (hit IS NOT NULL), 0)::DOUBLE AS success_rate, count(*) FILTER (NOT hit) / nullif(count(*) FILTER (hit IS NOT NULL), 0)::DOUBLE AS error_rate"


@query(f"""WITH {_RAW}, {_S_GOLD}, vmax AS (SELECT * FROM mcomp a WHERE score = (SELECT max(score) FROM mcomp b WHERE b.field_id = a.field_id)),
h AS (SELECT 'composite' AS kind, match_id = tag_id AS hit FROM nmax JOIN gold USING (field_id) UNION ALL SELECT 'votes', match_id = tag_id FROM vmax JOIN gold USING (field_id)) SELECT kind, {_HITS} FROM h GROUP BY 1""")
def composite_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = rank_first(_composite(spark, sf_dir), ["field_id"], F.desc("score")).withColumn("kind", F.lit("composite"))
    return compose.accuracy(best.unionByName(compose.votes_max(_raw(spark, sf_dir), compose.default_methods(spark)).withColumn("kind", F.lit("votes"))), _gold(spark), ["kind"])


@query(f"WITH {_RAW} SELECT field_id, method_name, max(score) AS score FROM raw GROUP BY ALL")
def raw_max_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.raw_max_scores(_raw(spark, sf_dir))


def _store(spark: SparkSession) -> StateStore:
    return StateStore(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}")


@query(f"WITH {_RAW} SELECT source_id, field_id, match_id, round(sum(score * score), 5) AS score FROM raw WHERE source_id = 3 AND field_id NOT IN (SELECT local_id FROM mappings) GROUP BY ALL")
def process_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that joins others end to end: models written and read, the four matchers on its unmapped fields, the composite."""
    store, cells, fields = _store(spark), model.cells(spark, sf_dir), model.fields(spark)
    for source in (1, 2, 4):
        mapping.preprocess_source(store, cells, fields, source, value_tokens.words)
    rows = mapping.process_source(store, cells, fields, model.attributes(spark), model.mappings(spark), _dictionary(spark, sf_dir), 3, tokenizer=value_tokens.words)
    return rows.withColumn("score", F.round("score", 5)).where("score > 0 or field_id is not null")


@query(f"WITH {_RAW} SELECT source_id, field_id, match_id, round(sum(score * score), 5) AS score FROM raw WHERE source_id = 3 AND method_name <> 'dist' AND field_id NOT IN (SELECT local_id FROM mappings) GROUP BY ALL")
def schema_map_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quick path over stored models of all sources: three matchers, one source."""
    store, cells, fields = _store(spark), model.cells(spark, sf_dir), model.fields(spark)
    mapping.preprocess_all(store, cells, fields, value_tokens.words)
    mapping.preprocess_global(store, model.attributes(spark), model.mappings(spark), _dictionary(spark, sf_dir), value_tokens.words)
    return mapping.map_source(store, fields, model.attributes(spark), model.mappings(spark), 3).withColumn("score", F.round("score", 5))


#: The parts' mappings are held back, and are the truth of a test run.
_HELD = tuple(i for i, source, _ in model.FIELDS if source == 3)
_S_TRUTH = "gold(field_id, tag_id) AS (VALUES " + ", ".join(f"({m[0]}::BIGINT, {m[1]}::BIGINT)" for m in MAPPINGS if m[0] in _HELD and m[2] * m[3] > 0.5) + f", ({_HELD[0]}::BIGINT, NULL))"
_S_TEST = _RAW.replace(s_affinity(), s_affinity(tuple(m for m in MAPPINGS if m[0] not in _HELD)))


@query(f"""WITH {_S_TEST}, {_S_TRUTH}, vmax AS (SELECT * FROM mcomp a WHERE score = (SELECT max(score) FROM mcomp b WHERE b.field_id = a.field_id)),
h AS (SELECT method_name AS kind, match_id = tag_id AS hit FROM best JOIN gold USING (field_id) UNION ALL SELECT 'composite', match_id = tag_id FROM nmax JOIN gold USING (field_id) UNION ALL SELECT 'votes', match_id = tag_id FROM vmax JOIN gold USING (field_id))
SELECT kind, {_HITS} FROM h GROUP BY 1""")
def mapping_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test run end to end: models of all sources that learn nothing of one source's mappings, which are then the truth."""
    truth = [(m[0], m[1]) for m in MAPPINGS if m[0] in _HELD and m[2] * m[3] > 0.5] + [(_HELD[0], None)]
    gold = spark.createDataFrame(truth, "field_id long, tag_id long")
    found = mapping.test_mapping(_store(spark), model.cells(spark, sf_dir), model.fields(spark), model.attributes(spark), model.mappings(spark), _dictionary(spark, sf_dir), gold, [3], tokenizer=value_tokens.words)
    return found[0].withColumnRenamed("method_name", "kind").unionByName(found[1].withColumn("kind", F.lit("composite")).drop("method_name")).unionByName(found[2].withColumn("kind", F.lit("votes")).drop("method_name"))


def _restricted(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store, cells, fields = _store(spark), model.cells(spark, sf_dir), model.fields(spark)
        mapping.preprocess_all(store, cells, fields, value_tokens.words)
        mapping.preprocess_global(store, model.attributes(spark), model.mappings(spark), _dictionary(spark, sf_dir), value_tokens.words)
        wanted = mapping.chosen_fields(fields, source_id=1, predicate="name like 'c_%a%'")
        return mapping.scores(store, method, wanted, model.attributes(spark)).withColumn("score", F.round("score", 6)).where("score > 0")

    run.__name__ = f"restricted_{method}"
    return run


for _method in compose.METHODS:
    query(f"WITH {_RAW} SELECT field_id, global_id, round(score, 6) AS score FROM m_{_method} JOIN fields f USING (field_id) WHERE f.source_id = 1 AND f.name LIKE 'c_%a%' AND round(score, 6) > 0")(_restricted(_method))


@query(f"""WITH {_RAW}, asked AS (SELECT field_id FROM fields WHERE field_id NOT IN (SELECT local_id FROM mappings)),
top AS (SELECT field_id, match_id, score, row_number() OVER (PARTITION BY field_id ORDER BY score DESC, match_id) AS place FROM ncomp WHERE field_id IN (SELECT field_id FROM asked) QUALIFY place <= 2)
SELECT field_id, match_id, round(score, 6) AS score, place FROM top UNION ALL
SELECT field_id, global_id, NULL, NULL FROM asked, attributes WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.field_id = asked.field_id AND match_id = global_id)""")
def crowd_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    composed = _composite(spark, sf_dir)
    return compose.questions(composed, model.fields(spark), model.attributes(spark), model.mappings(spark), 2).withColumn("score", F.round("score", 6))


@query()
def tree_meta_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(meta_tree.labelled_features(_raw(spark, sf_dir), model.mappings(spark)))
    return meta_tree.classify(meta_tree.train(rows), rows)


@query()
def tree_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(meta_tree.labelled_features(_raw(spark, sf_dir), model.mappings(spark)))
    return meta_tree.measures(meta_tree.stats(meta_tree.classify(meta_tree.train(rows), rows)))


@query(f"""WITH {_RAW}, pv AS (SELECT field_id, match_id, {_PIVOT} FROM raw GROUP BY ALL), k AS (SELECT qgrams + ngrams > 0.9 AS yes, EXISTS (SELECT 1 FROM mappings WHERE local_id = field_id AND global_id = match_id) AS truth FROM pv),
c AS (SELECT count(*) FILTER (yes AND truth) AS tp, count(*) FILTER (yes AND NOT truth) AS fp, count(*) FILTER (NOT yes AND truth) AS fn FROM k)
SELECT tp / nullif(tp + fn, 0)::DOUBLE AS recall, tp / nullif(tp + fp, 0)::DOUBLE AS precision, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f FROM c""")
def rule_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree's measures of fixed predictions by a rule."""
    rows = meta_tree.labelled_features(_raw(spark, sf_dir), model.mappings(spark))
    return meta_tree.measures(meta_tree.stats(rows.withColumn("class", (F.col("qgrams") + F.col("ngrams") > 0.9).cast("double"))))


@query()
def tree_split_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta_tree.split_test(_raw(spark, sf_dir), model.mappings(spark), model.fields(spark))


# Global token counts that follow two changes of the feedback by differences: authority of user 7 is taken away, then user 8's is halved.
def _feedback(spark: SparkSession, sf_dir: str, turn: int) -> DataFrame:
    weight = (F.lit(1.0), F.when(F.col("who_created") == 7, 0.0).otherwise(1.0), F.when(F.col("who_created") == 7, 0.0).otherwise(0.5))[turn]
    return aff.affinities(catalog.mappings(spark, sf_dir).withColumn("authority", F.col("authority") * weight)).where("affinity > 0")


_S_FEEDBACK = (
    f"{_CATALOG}, af AS (SELECT local_id, global_id, greatest(0.0, least(1.0, sum(confidence * authority * 0.5)))::DOUBLE AS affinity FROM mappings WHERE who_created = 8 GROUP BY ALL), "
    f"{s_words('lt', 'fields', 'field_id', 'name')}, {s_words('dt', 'attributes', 'global_id', 'name')}, "
    "g AS (SELECT global_id, gram, sum(c) AS c FROM (SELECT global_id, token AS gram, affinity AS c FROM lt JOIN af ON field_id = local_id UNION ALL SELECT global_id, token, 1.0 FROM dt) GROUP BY ALL HAVING sum(c) > 0)"
)


def _followed(spark: SparkSession, sf_dir: str) -> deltas.GlobalCounts:
    local = term_counts(catalog.fields(spark, sf_dir), ["field_id"], value_tokens.words(F.col("name")), "gram").checkpoint()
    own = term_counts(catalog.attributes(spark, sf_dir), ["global_id"], value_tokens.words(F.col("name")), "gram")
    states = [_feedback(spark, sf_dir, i).checkpoint() for i in range(3)]
    found = deltas.GlobalCounts.build(local, own, states[0])
    for before, after in zip(states[:-1], states[1:], strict=True):
        found = found.update(deltas.of_mappings(local, before, after))
    return found


@query(f"WITH {_S_FEEDBACK} SELECT global_id, gram, round(c, 6) AS c, round(c / sum(c) OVER (PARTITION BY global_id), 6) AS tf FROM g")
def global_counts_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after two changed sets of mappings, by differences alone."""
    return _followed(spark, sf_dir).shares().select("global_id", "gram", F.round("c", 6).alias("c"), F.round("tf", 6).alias("tf"))


@query(f"WITH {_S_FEEDBACK} SELECT gram, count(*)::BIGINT AS df FROM g GROUP BY 1")
def global_frequencies_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _followed(spark, sf_dir).df
