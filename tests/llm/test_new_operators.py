"""Whitening, substring removal and vector codes against brute force, with the edge cases of each."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import integers, substrings, vector_codes, whitening
from tests.conftest import DATA
from tests.llm.test_operators import LONG, edge_documents, empty_documents

VECTORS = "vec_id long, embedding array<float>, label int"


def edge_vectors(spark, width: int = 20):
    rng = np.random.default_rng(3)
    body = [(i, (rng.standard_normal(width) * (1 + np.arange(width))).round(2).tolist(), i % 3 if i % 7 else None) for i in range(150)]
    odd = [(200, None, 1), (201, [None] * width, 1), (202, [float("nan")] * width, 1), (203, [float("inf")] * width, None), (204, [], 1), (None, body[5][1], 2), (7, body[7][1], 1), (7, body[9][1], 1), (205, [0.0] * width, 0)]
    df = spark.createDataFrame(body + odd, VECTORS)
    for name in ("dims", "x", "code", "error", "component", "n", "part", "sums", "of"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def kept_rows(df):
    rows = [r for r in df.collect() if r["embedding"] and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    return rows, np.floor(256 * np.array([r["embedding"] for r in rows], float)).astype(np.int64)


def check_whitening(df, got):
    rows, x = kept_rows(df)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - fit.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(4, int((values > 1e-12 * values[0]).sum()))
    got = got.collect()
    assert len(got) == len(rows) * k
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-10)
    z = (x - fit.mean(0)) @ vectors[:, :k] / np.sqrt(values[:k])
    far = ((n * x - sums) ** 2).sum(1)
    for c in range(k):
        found = np.array([by[(r["vec_id"], int(f))][c + 1][0] for r, f in zip(rows, far, strict=True)])
        assert min(np.abs(found - z[:, c]).max(), np.abs(found + z[:, c]).max()) < 1e-8


def test_whitening(spark):
    df = edge_vectors(spark)
    check_whitening(df, whitening.whiten(df))
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").repartition(5)
    check_whitening(df, whitening.whiten(df))


def test_whitening_of_few_directions(spark):
    rng = np.random.default_rng(1)
    flat = (rng.standard_normal((40, 2)) @ rng.standard_normal((2, 30))).round(3)
    # Three distinct vectors span two directions; all others are rounding of floor.
    three = flat[:3].tolist()
    df = spark.createDataFrame([(i, three[i % 3], 0) for i in range(9)], VECTORS)
    check_whitening(df, whitening.whiten(df))
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    narrow = spark.createDataFrame([(i, [float(i), float(i * i % 5)], 0) for i in range(9)], VECTORS)
    check_whitening(narrow, whitening.whiten(narrow))


def test_whitening_by_length_and_huge_components(spark):
    rows = [(i, [float(i % 4), float(i % 3), 1.0], 0) for i in range(12)] + [(100 + i, [float(i), 1.0], 0) for i in range(4)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).groupBy("n").agg(F.countDistinct("vec_id").alias("v")).collect()
    assert sorted((r["n"], r["v"]) for r in got) == [(4, 4), (12, 12)]
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0], 0), (2, [-1e30, 1.0], 0), (3, [0.0, 2.0], 0)], VECTORS)).collect()
    assert huge and all(r["deviation"] is None or r["deviation"] >= 0 for r in huge)


@pytest.mark.parametrize("shape", ["plain", "ties", "low rank", "identity", "clusters"])
def test_block_lanczos(shape):
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    values = {"plain": rng.random(120) ** 3, "ties": np.repeat([5.0, 3.0, 1.0], 40), "low rank": np.append([3.0, 2.0], np.zeros(118)), "identity": np.ones(120), "clusters": 1 + 1e-3 * rng.random(120)}[shape]
    matrix = (q * values) @ q.T
    for width, blocks in ((8, 64), (4, 6)):
        it = whitening.BlockLanczos(120, 4, width, blocks)
        try:
            while not it.done:
                it.tell(matrix @ it.block)
        except RuntimeError:
            # So small a basis need not reach the residual for clustered values.
            assert blocks == 6 and shape == "clusters"
            continue
        assert np.allclose(it.values, np.sort(values)[::-1][:4], atol=1e-12)
        assert np.allclose(matrix @ it.vectors, it.vectors * it.values, atol=1e-11)
        assert np.allclose(it.vectors.T @ it.vectors, np.eye(4), atol=1e-12)


def test_lanczos_breakdown_goes_on_at_random():
    values = np.append([4.0, 2.0, 1.0], np.full(27, 0.5))
    it = whitening.BlockLanczos(30, 4, 5)
    it.start(np.eye(30)[:, :5])
    while not it.done:
        it.tell(values[:, None] * it.block)
    assert np.allclose(it.values, [4, 2, 1, 0.5])
    block, lost = whitening.orthonormal(np.zeros((6, 2)), np.eye(6)[:, :3], 1.0, np.random.default_rng(0))
    assert lost == 2 and np.allclose(block.T @ block, np.eye(2)) and np.allclose(block[:3], 0)


def brute_codes(rows, x, parts=16, rounds=2):
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["vec_id"] is None, rows[i]["vec_id"] or 0, integers.pack(x[i : i + 1])[0]))
    cut = np.array_split(np.arange(x.shape[1]), parts)
    books = [x[order[:64]][:, c].astype(object) for c in cut]

    def nearest():
        return np.array([[min(range(len(b)), key=lambda j: (sum((row[c] - b[j]) ** 2), j)) for c, b in zip(cut, books, strict=True)] for row in x.astype(object)])

    for _ in range(rounds):
        code = nearest()
        for i, c in enumerate(cut):
            for j in range(len(books[i])):
                mine = x[code[:, i] == j][:, c].astype(object)
                if len(mine):
                    books[i][j] = [sum(col) // len(mine) for col in mine.T]
    code = nearest()
    error = [int(sum(sum((row[c] - b[k]) ** 2) for c, b, k in zip(cut, books, ks, strict=True))) for row, ks in zip(x.astype(object), code, strict=True)]
    return [bytes(k.astype(np.uint8)).hex() for k in code], error, hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def check_codes(df, got):
    rows, x = kept_rows(df)
    code, error, sha = brute_codes(rows, x)
    totals = {}
    for r, e in zip(rows, error, strict=True):
        totals[r["label"]] = totals.get(r["label"], 0) + e
    want = sorted((r["vec_id"] or -1, c, e, totals[r["label"]], sha) for r, c, e in zip(rows, code, error, strict=True))
    assert sorted((r["vec_id"] or -1, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got.collect()) == want


def test_vector_codes(spark):
    df = edge_vectors(spark, 32)
    check_codes(df, vector_codes.compress(df))
    # A length without equal parts, few vectors, and many ties.
    df = edge_vectors(spark, 19)
    check_codes(df, vector_codes.compress(df))
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, (rng.integers(-1, 2, 16) / 128).tolist(), i % 2) for i in range(120)], VECTORS)
    check_codes(df, vector_codes.compress(df.repartition(3)))
    df = spark.createDataFrame([(i, (rng.integers(-4, 4, 16) / 64).tolist(), None) for i in range(5)], VECTORS)
    check_codes(df, vector_codes.compress(df))
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, [1e30] * 16, 0), (2, [-1e30] * 16, 0)], VECTORS)).count() == 2


def test_bounds_skip_scans_and_change_nothing():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.integers(-2000, 2000, (40, 4)).repeat(50, 0) + rng.integers(-30, 30, (2000, 4)), rng.integers(-3, 3, (500, 4))])
    book = x[rng.permutation(len(x))[:32]].copy()
    code, upper, lower = np.zeros(len(x), np.uint8), np.zeros(len(x), np.float32), np.zeros(len(x), np.float32)
    before, scans = None, []
    for _ in range(6):
        known = vector_codes.Codebooks([book], before)
        scans.append(known.assign(0, x, code, upper, lower))
        square = ((x[:, None] - book) ** 2).sum(2)
        assert (code == square.argmin(1)).all()
        exact, second = np.sqrt(square.min(1)), np.sqrt(np.partition(square, 1, axis=1)[:, 1])
        assert (upper >= exact).all() and (lower <= second).all()
        before = [book]
        book = np.array([x[code == j].sum(0) // max((code == j).sum(), 1) if (code == j).any() else book[j] for j in range(len(book))])
    assert scans[0] == len(x) and scans[-1] < len(x) / 2


def brute_substrings(rows, window=13):
    first, words = {}, [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(v for j, v in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def passages(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "中文", "😀", "the", "of"]
    passage, common = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(4)], " ".join(rng.choices(vocabulary, k=6))
    rows = []
    for i in range(160):
        parts = [rng.choice([" ", "\n", "\t ", "\x0b"]).join(rng.choices(vocabulary, k=rng.randint(0, 50))) for _ in range(3)]
        parts += [rng.choice(passage)] * rng.randint(0, 2) + [common] * rng.randint(0, 3)
        rng.shuffle(parts)
        rows.append((rng.randint(0, 140) if i % 20 else None, " ".join(parts)))
    rows += [(500 + i, rows[i][1]) for i in range(30)] + [(rows[3][0], rows[3][1]), (900, "same " * 700), (901, "same " * 300), (902, "a b " * 200), (899, "b a " * 100)]
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 3000, "limit": 2000}, {"bucket_bytes": 2000, "limit": 1}])
def test_substrings(spark, options):
    for df in (passages(spark).repartition(3), edge_documents(spark)):
        want = brute_substrings([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
        assert sorted(map(tuple, substrings.digests(df, **options).collect()), key=repr) == want
    assert substrings.digests(empty_documents(spark), **options).count() == 0


def test_substrings_across_chunks(spark, monkeypatch):
    df = passages(spark).coalesce(1)
    want = brute_substrings([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    texts, ids = zip(*[((r["text"] or "").encode(), r["doc_id"]) for r in df.collect()], strict=True)
    assert [len(re.findall(rb"[^\x20\x09-\x0d]+", t)) for t in texts] == substrings.pack_texts(list(texts))[1].tolist()
    assert sum(1 for _ in ids) == len(want)
    kept = substrings.remove(df.withColumn("text", F.concat("text", F.lit(" " + LONG)))).agg(F.max(F.length("text"))).first()[0]
    assert kept >= len(LONG) - 1


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    words = [b"%d" % i for i in range(40)]
    texts = [b" ".join(words[i : i + 14]) for i in range(6)] * 2
    low = np.arange(len(texts))[::-1].copy()
    own, least = substrings.smallest_owner(texts, low)
    monkeypatch.setattr(substrings, "window_spans", lambda t, real=substrings.window_spans: (*real(t)[:4], np.zeros(len(real(t)[4]), np.uint64)))
    again, apart = substrings.smallest_owner(texts, low)
    assert (own == again).all() and (least == apart).all()


@pytest.mark.parametrize("repeats", [1, 3, 9])
def test_top_k_with_repeated_ids(spark, repeats):
    from tessella.llm import topk

    k = 3
    rng = np.random.default_rng(repeats)
    rows = [(100, [5.0, 5.0])] * repeats + [(101 + i, [5.0, 5.0]) for i in range(6)] + [(200 + i, [5.0, 5.0]) for i in range(2) for _ in range(repeats)] + [(300 + i, rng.standard_normal(2).round(3).tolist()) for i in range(40)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).coalesce(1)
    for parts in (1, 4):
        got = topk.top_k(frame.repartition(parts), frame.where("vec_id % 100 = 0"), k).collect()
        for q in (100, 200, 300):
            x = np.floor(1024 * np.array(next(v for i, v in rows if i == q)))
            scores = sorted((-int(np.floor(1024 * np.array(v)) @ x), i) for i, v in rows if i != q)[:k]
            assert [(r["vec_id"], -r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(i, s) for s, i in scores]


def test_kernel_ridge_sums_equal_a_dense_fit(spark):
    """The summed normal equations of the quality classifier against one dense matrix of all features."""
    from tessella.llm import quality
    from tessella.llm.common import WordHasher

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(quality.describe(docs.repartition(5)), labels)
    known = {r["doc_id"]: r["quality"] for r in labels.where("quality in (0, 1)").withColumn("fold", quality.fold()).where("fold in (0, 1)").collect()}
    rows = [(r["text"] or "", known[r["doc_id"]]) for r in docs.orderBy("doc_id").collect() if r["doc_id"] in known]
    x = np.vstack([quality.statistics([t], WordHasher()) for t, _ in rows]).astype(np.float32).astype(float)
    y = np.array([q for _, q in rows], float)
    deviation = np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    features = quality.Map(x.mean(0), deviation)
    z = features(x)
    weights = np.linalg.solve(z.T @ z + quality.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y)
    assert np.abs(features(x) @ weights - model.features(x) @ model.weights).max() < 1e-6


@pytest.mark.parametrize("name", ["op12_substring_dedup", "op13_vector_codes"])
def test_new_queries_equal_their_sql(spark, name):
    import duckdb

    from tessella.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall())
