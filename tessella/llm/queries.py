"""The registered queries of the training-data operators, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship_package
from . import embedding_dups, licenses, mixing, near_dups, packing, quality, substrings, token_files, topk, url_filter, vector_codes, warc, whitening
from .common import workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark)
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, "byte_bpe_50k.json", 2)
    return token_files.read_tokens(spark, path, digest=True)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["doc_id"])
    return taken.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark)
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def license_paths(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text): documents as files, whose names and places follow from doc_id, source and lang alone. Of seven one is a licence file,
    in a directory of one to three levels; the others are sources in the deepest ones."""
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    last = F.concat(F.lit("part"), F.coalesce(F.pmod("doc_id", F.lit(29)).cast("string"), F.lit("none")))
    folder = F.concat_ws("/", "source", F.when(F.pmod("doc_id", F.lit(3)) > 0, F.coalesce("lang", F.lit("any"))), F.when(F.pmod("doc_id", F.lit(3)) > 1, last))
    deep = F.concat_ws("/", "source", F.coalesce("lang", F.lit("any")), last)
    path = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.concat_ws("/", folder, F.concat(F.lit("LICENSE-"), number))).otherwise(F.concat_ws("/", deep, F.concat(number, F.lit(".txt"))))
    return docs.select("doc_id", path.alias("path"), "text")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(license_paths(_table(spark, sf_dir, "documents"))).withColumn("cosine", F.round("cosine", 6))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), "word_bpe_49k.json", 1, 4096)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


_OPERATORS = (op1_quality_classifier, op2_token_files, op3_source_mixing, op4_minhash_near_dedup, op5_warc_bundles, op6_exact_top_k, op7_license_scan, op8_url_filter, op9_embedding_near_dedup, op10_best_fit_packing)
_NEW = (op11_embedding_whitening, op12_substring_dedup, op13_vector_codes)
QUERIES = {f.__name__: f for f in (*_OPERATORS, *_NEW)}


def _codes_sql() -> str:
    """Two rounds of Lloyd's method over all parts, without bounds."""

    def nearest(name: str, books: str) -> str:
        square = "list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x)"
        return f"{name} AS MATERIALIZED (SELECT r, part, min(({square})::BIGINT * 64 + entry) AS best FROM p JOIN {books} b USING (part) GROUP BY r, part)"

    def moved(name: str, books: str, codes: str) -> str:
        means = f"SELECT part, best % 64 AS entry, pos, floor(sum(x[pos]) / count(*)) AS mean FROM p JOIN {codes} USING (r, part), (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS pos) WHERE pos <= len(x) GROUP BY ALL"
        return f"{name} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM {books} b LEFT JOIN (SELECT part, entry, list(mean ORDER BY pos) AS x FROM ({means}) GROUP BY ALL) m USING (part, entry))"

    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, x[part * len(x) // 16 + 1 : (part + 1) * len(x) // 16] AS x FROM v, (SELECT unnest(range(16)) AS part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM p WHERE r <= 64),
{nearest("a0", "b0")}, {moved("b1", "b0", "a0")}, {nearest("a1", "b1")}, {moved("b2", "b1", "a1")}, {nearest("a2", "b2")},
c AS (SELECT r, string_agg(format('{{:02x}}', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY r),
s AS (SELECT sha256(string_agg(z, ',' ORDER BY part, entry)) AS sha FROM (SELECT part, entry, array_to_string(list_transform(x, lambda y: y::BIGINT::VARCHAR), ',') AS z FROM b2))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256 FROM v JOIN c USING (r), s"""


def _license_sql() -> str:
    texts = ", ".join("({}, '{}', {}, '{}')".format(t, name, least, text.replace("'", "''")) for t, name, least, text in licenses.template_rows())
    word = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
    folder = "concat_ws('/', source, CASE WHEN doc_id % 3 > 0 THEN coalesce(lang, 'any') END, CASE WHEN doc_id % 3 > 1 THEN 'part' || doc_id % 29 END)"
    return f"""
WITH f AS (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN concat_ws('/', {folder}, 'LICENSE-' || doc_id)
  ELSE concat_ws('/', source, coalesce(lang, 'any'), 'part' || doc_id % 29, doc_id || '.txt') END AS path FROM documents),
w AS (SELECT doc_id, unnest(list_distinct({word.format("text")})) AS word FROM f), n AS (SELECT count(*) AS n FROM f),
i AS (SELECT word, ln((n + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM w, n GROUP BY word, n),
t(t, license, least, notice) AS (VALUES {texts}), tw AS (SELECT t, license, least, unnest({word.format("notice")}) AS word FROM t),
tv AS (SELECT t, license, least, word, (1 + ln(count(*))) * coalesce(any_value(idf), any_value(ln(n + 1) + 1)) AS w FROM tw LEFT JOIN i USING (word), n GROUP BY ALL),
tn AS (SELECT t, sqrt(sum(w * w)) AS norm FROM tv GROUP BY t),
u0 AS (SELECT doc_id, path, unnest(list_concat(string_split(text, chr(10)), list_filter(string_split_regex(text, '\\n[\\x20\\t\\r]*\\n'), lambda p: contains(p, chr(10))),
  CASE WHEN regexp_matches(path, '{licenses.FILE}') THEN [text] ELSE [] END)) AS unit FROM f WHERE text IS NOT NULL),
u1 AS (SELECT doc_id, path, row_number() OVER () AS u, {word.format("unit")} AS words FROM u0 WHERE regexp_matches(unit, '(?i)[a-z0-9]')),
u2 AS (SELECT * FROM u1 WHERE list_has_any(words, (SELECT list(DISTINCT word) FROM tw WHERE length(word) > 1))),
x AS (SELECT doc_id, path, u, word, count(*) AS c FROM (SELECT doc_id, path, u, unnest(words) AS word FROM u2) GROUP BY ALL),
xw AS (SELECT doc_id, path, u, word, (1 + ln(c)) * idf AS w FROM x JOIN i USING (word)), xn AS (SELECT u, sqrt(sum(w * w)) AS norm FROM xw GROUP BY u),
d AS (SELECT doc_id, path, u, t, license, least, sum(xw.w * tv.w) AS dot FROM xw JOIN tv USING (word) GROUP BY ALL),
c AS (SELECT doc_id, path, license, round(dot / (xn.norm * tn.norm), 9) AS cosine FROM d JOIN xn USING (u) JOIN tn USING (t) WHERE round(dot / (xn.norm * tn.norm), 9) >= least),
own AS (SELECT f.doc_id, f.path, b.license, b.cosine FROM f LEFT JOIN (SELECT doc_id, path, license, cosine FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) = 1) b USING (doc_id)),
dec AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, path AS file, license AS given FROM own WHERE license IS NOT NULL AND regexp_matches(path, '{licenses.FILE}')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path) = 1),
h AS (SELECT o.doc_id, d.file, d.given FROM own o JOIN dec d ON d.dir = '' OR starts_with(o.path, d.dir || '/') WHERE o.license IS NULL QUALIFY row_number() OVER (PARTITION BY o.doc_id ORDER BY length(d.dir) DESC) = 1)
SELECT doc_id, path, coalesce(license, given) AS license, round(cosine, 6) AS cosine, file AS inherited_from FROM own LEFT JOIN h USING (doc_id)"""


#: DuckDB SQL of the queries that it can express; the others are held against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op5_warc_bundles": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS hex FROM p),
m AS (SELECT hex, max(page_id) AS top FROM h GROUP BY hex)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, ((i // 8) * 10 + 1)::BIGINT, 10))::BIGINT) >> (35 - 5 * (i % 8))::BIGINT) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM h JOIN m USING (hex)""",
    "op7_license_scan": _license_sql(),
    "op6_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS low FROM embeddings UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(low) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op12_substring_dedup": """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
k AS MATERIALIZED (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS gram FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE doc_id IS NOT NULL)),
m AS (SELECT gram, min(doc_id) AS least FROM k GROUP BY gram HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT r, i + j AS i FROM k JOIN m USING (gram), (SELECT unnest(range(13)) AS j) WHERE least < doc_id),
u AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
n AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM u ANTI JOIN g USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r)""",
    "op13_vector_codes": _codes_sql(),
}
