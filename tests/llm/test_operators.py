"""The training-data operators against brute force, exact round trips and held-out accuracy, with the edge cases of each."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import embedding_dups, licenses, mixing, near_dups, packing, quality, token_files, topk, url_filter, warc
from tessella.llm.common import WordHasher, connected_components, workspace
from tessella.llm.tokens import encoder, vocabulary_path
from tests.conftest import DATA

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 40_000


def edge_documents(spark, extra: str = ""):
    """Nulls in any column, empty and very long texts, ties and repeated rows, and extra columns with clashing names."""
    rows = [(1, "One two three four five six.", "en", "a", 5), (2, "One two three four five six.", "en", "b", 5), (2, "One two three four five six.", "en", "b", 5), (3, None, None, None, None), (4, "", "en", "a", 0), (5, LONG, "en", None, 9), (None, "no id", "en", "a", 5), (7, " \n\t ", "en", "b", 3), (8, "é 中 😀 <|endoftext|> don't\r\n\r\n  x", "fr", "c", 9)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("size", "row", "score", "rep", "ids", "copies", "target", "doc", "key", "kept", "statistics"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_tokens_equal_the_library():
    rng = random.Random(5)
    alphabet = [*"abcéßñ中😀'’.,!1²ªΣςİ \n\t\r\x0b\x1c", "\xa0", "\u2003", "\u3000", "e\u0301", "don't ", "the ", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = encoder(name)
        ids, at = enc.encode(texts)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_added_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|ENDOFTEXT|>y", "a<|startoftext|>  b <|endoftext|><|endoftext|>", "é <|endoftext|> 中\u2003z", "<|endof text|>", "no such token"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(vocabulary_path(name))
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        ids, at = encoder(name).encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
        path = workspace(spark)
        token_files.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, name, 2)
        got = token_files.read_tokens(spark, path).orderBy("doc_id").collect()
        assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == [[*w, 2] for w in want]
    assert 50256 in encoder("byte_bpe_50k.json").encode(texts[:1])[0]


@given(st.lists(st.text(max_size=30), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_word_hashes(texts):
    hashes, at = WordHasher()(texts)
    for i, t in enumerate(texts):
        words = [w for w in t.encode("utf-8", "replace").translate(bytes(32 if c in b"\t\n\x0b\x0c\r" else c for c in range(256))).split(b" ") if w]
        assert at[i + 1] - at[i] == len(words)
    again, _ = WordHasher()(texts)
    assert (hashes == again).all()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 300), (7, 7)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == 100 and got[1049] == 1000
    assert connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


# 1 quality
def test_quality_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    got = quality.score(spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet"))
    held = got.join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(held) > 50 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.collect())


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0), (4, None, 0), (99, 1, 0), (5, 0, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    docs = edge_documents(spark)
    rows = quality.score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = quality.score(docs, labels.limit(0)).collect()
    assert all(r["score"] == 0.5 for r in none)
    assert quality.score(empty_documents(spark), labels).isEmpty()
    assert quality.keep(docs, labels.limit(0)).columns == docs.columns


def test_isotonic():
    fit = quality.isotonic(np.array([1, 1, 2, 1]), np.array([0, 1, 0, 1]))
    assert fit.tolist() == [0, 1 / 3, 1 / 3, 1]


# 2 token files
def _by_library(texts, name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(name))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


def test_token_round_trip(spark, documents):
    path = workspace(spark)
    token_files.write_tokens(documents, path, "byte_bpe_50k.json", 2)
    got = token_files.read_tokens(spark, path).orderBy("doc_id").collect()
    want = documents.orderBy("doc_id").collect()
    start = 0
    for g, w, ids in zip(got, want, _by_library([r["text"] for r in want], "byte_bpe_50k.json", 2), strict=True):
        assert (g["doc_id"], g["start"], g["n_tokens"], bytes(g["ids"])) == (w["doc_id"], start, len(ids), ids.tobytes())
        start += len(ids)
    digest = {r["doc_id"]: r["ids_crc32"] for r in token_files.read_tokens(spark, path, digest=True).collect()}
    assert digest == {g["doc_id"]: zlib.crc32(bytes(g["ids"])) for g in got}


def test_token_edges(spark):
    path = workspace(spark)
    token_files.write_tokens(edge_documents(spark), path, "byte_bpe_50k.json", 2)
    rows = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 2, 3, 4, 5, 7, 8] and rows[4]["n_tokens"] == 1
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows[:-1]]]).tolist()
    path = workspace(spark)
    token_files.write_tokens(empty_documents(spark), path, "byte_bpe_50k.json", 2)
    assert token_files.read_tokens(spark, path).isEmpty()


def test_token_segments_split_a_shared_doc_id(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 2000)
    docs = spark.createDataFrame([(None if i % 3 else i, f"text {i} " * 20) for i in range(300)], "doc_id long, text string")
    path = workspace(spark)
    token_files.write_tokens(docs, path, "byte_bpe_50k.json", 2)
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("segment").agg(F.sum("ids").alias("n")).collect()
    assert len(sizes) > 8 and max(r["n"] for r in sizes) < 5 * sum(r["n"] for r in sizes) / len(sizes)
    rows = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None] * 200 + [i for i in range(300) if i % 3 == 0]
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows[:-1]]]).tolist()


@given(st.lists(st.integers(1, 10**9), min_size=2, max_size=300), st.integers(9, 16))
@settings(max_examples=60, deadline=None)
def test_code_lengths(counts, limit):
    lengths = token_files.code_lengths(np.array(counts), limit)
    assert lengths.max() <= limit and abs(sum(2.0 ** -float(x) for x in lengths) - 1) < 1e-9
    order = np.argsort(counts, kind="stable")
    assert (np.diff(lengths[order]) <= 0).all()


def test_damaged_block(spark):
    block = token_files._block(0, [(1, 1, np.array([0], "<u8").tobytes(), b"\x80")])
    with pytest.raises(ValueError):
        token_files.decode_block(block[:-5] + b"\x00" + block[-4:], (np.zeros(2, np.uint32), np.ones(2, np.int64)), 1)


# 3 mixing
def test_mixing_targets_and_sizes(spark, documents):
    rows = mixing.copies(documents, ["doc_id", "source"]).select("doc.doc_id", F.col("doc.source").alias("source"), "size", "source_size", "target", "copies").collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert all(r["size"] == len([w for w in texts[r["doc_id"]].translate({i: " " for i in range(9, 14)}).split(" ") if w]) for r in rows)
    sources = sorted({r["source"] for r in rows})
    size = {s: sum(r["size"] for r in rows if r["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    left, target, open_ = 1.5 * sum(size.values()), {}, set(sources)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s] + 1e-9}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    for s in sources:
        own = [r for r in rows if r["source"] == s]
        assert all(math.isclose(r["target"], target[s], rel_tol=1e-9) and r["copies"] <= 2 for r in own)
        assert abs(sum(r["size"] * r["copies"] for r in own) - target[s]) <= max(r["size"] for r in own)
    again = mixing.copies(documents, ["doc_id", "source"]).select("doc.doc_id", "copies")
    assert {tuple(r) for r in again.collect()} == {(r["doc_id"], r["copies"]) for r in rows}


def test_mixing_reruns_agree_in_any_order_and_partitioning(spark, documents):
    small = documents.where("doc_id < 60")
    docs = documents.union(small).union(small).union(documents.where("doc_id = 7").crossJoin(spark.range(300)).drop("id"))

    def taken(df):
        return sorted(tuple(r) for r in mixing.copies(df, ["doc_id"]).select("doc.doc_id", "target", "size", "copies").collect())

    first = taken(docs)
    assert len(first) == docs.count()
    assert taken(docs.repartition(7)) == first and taken(docs.orderBy(F.desc("n_chars")).coalesce(1)) == first
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        again = spark.read.parquet(f"{DATA}/documents.parquet")
        small = again.where("doc_id < 60")
        assert taken(again.union(again.where("doc_id = 7").crossJoin(spark.range(300)).drop("id")).union(small).union(small)) == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_mixing_edges(spark):
    docs = edge_documents(spark)
    rows = mixing.copies(docs, ["doc_id"]).collect()
    assert len(rows) == docs.count() and all(0 <= r["copies"] <= 2 for r in rows) and all(r["target"] <= 2 * r["source_size"] for r in rows)
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(empty_documents(spark)).isEmpty()


def test_pivotal_rounding_keeps_marginals():
    size, p = np.array([10, 20, 30, 40, 50]), np.array([0.3, 0.6, 0.5, 0.2, 0.7])
    total = np.zeros(5)
    rng = np.random.default_rng(1)
    for _ in range(20_000):
        got, at = mixing.round_block(size, p, rng.random(5))
        assert abs(got @ size - p @ size) < 1e-6 and ((got == 0) | (got == 1) | (np.arange(5) == at)).all()
        total += got
    assert np.abs(total / 20_000 - p).max() < 0.02


# 4 near duplicates
def _brute_classes(docs, threshold=0.8):
    """Classes by counters of word tuples: no hash, weight or helper of the operator."""
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    bags = []
    for r in rows:
        words = [w for w in re.split("[\\x20\\x09-\\x0d]+", (r["text"] or "").lower()) if w]
        bags.append(Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter())
    df, n = Counter(s for b in bags for s in b), max(len(rows), 2)
    weights = [{s: c * (1 + math.log(n / df[s]) / math.log(n)) for s, c in b.items()} for b in bags]
    totals = [sum(w.values()) for w in weights]
    holders, parent = {}, list(range(len(rows)))
    links = set()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in enumerate(weights):
        low = Counter()
        for s, w in own.items():
            for j in holders.get(s, ()):
                low[j] += min(w, weights[j][s])
            holders.setdefault(s, []).append(i)
        for j, shared in low.items():
            if shared / (totals[i] + totals[j] - shared) >= threshold - 1e-9:
                links.add((j, i))
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {r["doc_id"]: rows[root(i)]["doc_id"] for i, r in enumerate(rows)}


def _variants(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows, doc = [], 0
    for g in range(12):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(rng.choice([1, 2, 9, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((doc, " ".join(copy), "en", "a", 1))
            doc += 1
    return spark.createDataFrame(rows, DOCS)


def test_near_duplicates_equal_brute_force(spark):
    for docs in (_variants(spark), spark.read.parquet(f"{DATA}/documents.parquet")):
        got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(docs).collect()}
        assert got == _brute_classes(docs)


def test_near_duplicate_recall_at_a_thousand_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(docs).collect()}
    want = _brute_classes(docs)
    copies = [d for d in want if want[d] != d]
    assert len(copies) > 50 and np.mean([got[d] == want[d] for d in copies]) >= 0.99 and all(got[d] == d or want[d] != d for d in got)


def test_regular_words_are_told_apart(spark):
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    hashes, _ = WordHasher()([f"{a} {b} {a * 3} {b * 3}"])
    assert len(set(hashes.tolist())) == 4
    rows = near_dups.near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == {1: 1, 2: 2, 3: 1}
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = encoder(name)
        ids, at = enc.encode([a, b])
        assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in (a, b)]


@given(st.lists(st.integers(0, 2**40 - 1), max_size=200, unique=True), st.integers(40, 64))
@settings(max_examples=80, deadline=None)
def test_sorted_numbers_round_trip(values, bits):
    x = np.array(sorted(values), np.uint64)
    assert (near_dups.decode_sorted(near_dups.code_sorted(x, bits), bits) == x).all()
    counts = np.array([v % 5 + 1 for v in values], np.int64)
    assert (near_dups._unpack_counts(near_dups._pack_counts(counts), len(counts)) == counts).all()


def test_hot_texts_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "HOT", 5)
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, text) for i in range(40)] + [(100, text + " x"), (101, "another text of six words here")], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(docs).collect()}
    assert len(got) == 42 and all(got[i] == 0 for i in [*range(40), 100]) and got[101] == 101


def test_near_duplicate_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    docs = _variants(spark)
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(docs).collect()}
    assert got == _brute_classes(docs)


def test_shingles_of_one_document_weigh_the_top_in_any_table(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "RANGE", 20_000)
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(405))) for i in range(2000)]
    rows += [(2000 + i, "a passage that ten of all these documents hold") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = docs.mapInArrow(near_dups._pack, "batch long, docs long, size long, rows binary").checkpoint()
    size, batches = packed.agg(F.sum("size"), F.count("*")).first()
    ranges, bits = near_dups._layout(size, batches)
    assert ranges > 3
    counts = [x for r in near_dups._frequencies(packed, ranges, bits).collect() for x in near_dups._known(r["cells"])]
    assert sorted(set(counts)) == [1, 10] and counts.count(1) == 2000 * 401
    assert np.allclose(near_dups._inverse(np.array([1.0]), 2010), 2)


def test_near_duplicate_edges(spark):
    docs = edge_documents(spark)
    rows = near_dups.near_duplicates(docs).collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert len(rows) == docs.count() and got[2] == 1 and got[3] == 3 and got[4] == 4 and got[7] == 7 and got[None] is None
    kept = near_dups.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 4, 5, 7, 8]
    assert near_dups.near_duplicates(empty_documents(spark)).isEmpty()


def test_samples_estimate_similarity():
    rng = np.random.default_rng(2)
    for shared in (200, 320, 380):
        got, true = [], []
        for _ in range(30):
            u, w = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.uniform(1, 3, 800)
            a, b = np.argsort(u[:400]), np.argsort(np.r_[u[:shared], u[400 : 800 - shared]])
            x, y = (u[:400][a], w[:400][a]), (np.r_[u[:shared], u[400 : 800 - shared]][b], np.r_[w[:shared], w[400 : 800 - shared]][b])
            got.append((near_dups.sample(*x) == near_dups.sample(*y)).mean())
            true.append(near_dups.weighted_jaccard(x, y))
            assert math.isclose(near_dups.similar(*x, [y, x])[0], true[-1])
        assert abs(np.mean(got) - np.mean(true)) < 0.04


# 5 WARC
def test_warc_round_trip(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    path = workspace(spark)
    both = pages.union(pages.where("page_id < 10").select(F.col("page_id") + 100_000, "url", "html"))
    warc.write_archive(both, path)
    rows = {r["page_id"]: r for r in warc.read_archive(spark, path, payloads=True).collect()}
    html = {r["page_id"]: (r["html"] or "").encode() for r in both.collect()}
    assert set(rows) == set(html)
    for i, r in rows.items():
        top = max(k for k, v in html.items() if v == html[i])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html[i]), base64.b32encode(hashlib.sha1(html[i]).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == top else ("revisit", top))
        assert r["payload"] == (html[i] if i == top else None)
    data = {r["bundle"]: bytes(r["data"]) for r in spark.read.parquet(path).collect()}
    for r in warc.index(spark, path).limit(20).collect():
        head, _, end = warc.parse(warc.read_record(data[r["bundle"]], r["frame"], r["offset"], r["length"]), 0)
        assert head["warc-record-id"] == f"<urn:page:{r['page_id']}>" and end == r["length"]
    whole = zstandard.ZstdDecompressor().stream_reader(next(iter(data.values())), read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1\r\n")


def test_warc_files(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    path = workspace(spark)
    warc.write_archive(pages, path)
    files = warc.export(spark, path, f"file://{tmp_path}").collect()
    assert files and sorted(r["file"] for r in files) == sorted(map(str, tmp_path.iterdir()))
    records = 0
    for r in files:
        with open(r["file"], "rb") as f:
            raw = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        at = 0
        while at < len(raw):
            _, _, at = warc.parse(raw, at)
            records += 1
    assert records == pages.count()


def test_warc_digests_beyond_the_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"page {i % 3}") for i in range(30)], "page_id long, url string, html string")
    first = {r["page_id"]: r["refers_to"] for r in warc.classify(pages).collect()}
    monkeypatch.setattr(warc, "BROADCAST", 0)
    assert {r["page_id"]: r["refers_to"] for r in warc.classify(pages).collect()} == first
    assert first[0] == 27 and first[29] is None


def test_warc_edges(spark):
    rows = [(1, None, None), (2, "http://x/\r\n", ""), (2, "http://x", ""), (None, "u", "a"), (3, "u", "a"), (4, "u", LONG), (5, "u", "é\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("data", F.lit(1))
    path = workspace(spark)
    warc.write_archive(pages, path)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archive(spark, path).collect()), key=str)
    assert got == sorted([(1, "revisit", 2, 0), (2, "response", None, 0), (2, "response", None, 0), (None, "revisit", 3, 1), (3, "response", None, 1), (4, "response", None, len(LONG)), (5, "response", None, 14)], key=str)
    assert warc.classify(pages, least=1).where("refers_to is not null").count() == 1
    path = workspace(spark)
    warc.write_archive(pages.limit(0), path)
    assert warc.read_archive(spark, path).isEmpty()


# 6 top-k
def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("x", F.lit("clash")).withColumn("score", F.lit(0))


def _brute_top(rows, k):
    fine = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in fine if i % 100 == 0}:
        x = next(v for i, v in fine if i == q)
        best = sorted((-int(x @ v), i) for i, v in fine if i != q and len(v) == len(x))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 800)
    monkeypatch.setattr(topk, "BLOCK", 128)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)], 0) for i in range(700)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(15)] + [(2000, None, 0), (2001, [1.0, None], 0), (2002, [float("nan")] * 8, 0), (2003, [float("inf")] * 8, 0), (2004, [], 0), (2100, [1.0, 2.0], 0), (2101, [3.0, 4.0], 0), (None, [1.0] * 8, 0)]
    vectors = _vectors(spark, rows)
    got = {tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 100 = 0")).collect()}
    assert got == _brute_top(rows, 10)
    few = [(100, [1.0, 2.0], 0), (100, [1.0, 2.0], 0), (7, [3.0, 1.0], 0), (7, [3.0, 1.0], 0), (8, [0.5, 0.5], 0)]
    found = topk.top_k(_vectors(spark, few), _vectors(spark, few).where("vec_id = 100")).orderBy("rank").collect()
    assert [tuple(r)[1:] for r in found] == [(1, 7, 5 * 1024 * 1024), (2, 7, 5 * 1024 * 1024), (3, 8, 3 * 512 * 1024)]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).isEmpty()


# 7 licences
def _brute_licenses(rows):
    def bag(t):
        return Counter(re.findall(r"[a-z0-9]+", (t or "").lower()))

    df, n = Counter(w for _, _, t in rows for w in bag(t)), len(rows)
    vec = lambda b: {w: (1 + math.log(c)) * (math.log((n + 1) / (df[w] + 1)) + 1) for w, c in b.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, least, vec(bag(text))) for _, name, least, text in licenses.template_rows()]
    out = {}
    for i, p, t in rows:
        named = bool(p and re.search(r"(?i)(^|/)(un)?licen[cs]e[^/]*$|(^|/)(copying|notice)[^/]*$", p))
        best = []
        for u in (t or "").split("\n") + [x for x in re.split(r"\n[ \t\r]*\n", t or "") if "\n" in x] + ([t or ""] if named else []):
            v = vec(bag(u))
            for name, least, x in templates if v else ():
                c = round(sum(v.get(w, 0) * x[w] for w in x) / (norm(v) * norm(x)), 9)
                if c >= least:
                    best.append((-c, name))
        out[i, p] = min(best, default=None)
    return out


APACHE = """# Copyright 2020 The Authors
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     https://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2019 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def test_licenses_equal_brute_force_and_inherit(spark):
    rows = [
        (1, "a/LICENSE", MIT), (2, "a/b/x.py", "print(1)"), (3, "a/b/c/y.py", APACHE + "\nimport os\n"), (4, "a/b/c/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted to copy"),
        (5, "a/b/c/d/z.py", None), (6, "other.py", "x"), (7, None, "Licensed under CC BY-NC 4.0."), (8, None, ""), (9, "ab/w.py", "the the the license"), (9, "ab/w.py", "the the the license"), (10, "a/b/x.py", LONG),
        (11, "q/s.c", "// SPDX-License-Identifier: Apache-2.0\nint x;"), (12, "q/t.c", "/* SPDX-License-Identifier: GPL-2.0-only */"), (13, "q/u.c", "SPDX-License-Identifier: Unknown-9.9"), (14, "q/v.c", "Anyone may license this."), (15, "a/b/c/d/e/f.txt", "plain"), (16, "LICENSE", "Released under the MIT License."), (17, "zz.py", ""),
    ]
    rows += [(100 + i, f"n/{i}.txt", " ".join(f"the word{i % 7} of file{j}" for j in range(9))) for i in range(60)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash")).withColumn("words", F.lit(1)).withColumn("unit", F.lit(1))
    got = {(r["doc_id"], r["path"]): r for r in licenses.scan(files).collect()}
    want = _brute_licenses(rows)
    for k, r in got.items():
        assert (r["cosine"] is None) == (want[k] is None) and (want[k] is None or (r["license"] == want[k][1] and abs(r["cosine"] + want[k][0]) < 1e-6)), k
    name = {k[0]: (r["license"], r["inherited_from"]) for k, r in got.items() if k != (10, "a/b/x.py")}
    assert name[1] == ("MIT", None) and name[3] == ("Apache-2.0", None) and name[4] == ("GPL-3.0", None) and name[11][0] == "Apache-2.0" and name[12][0] == "GPL-2.0-only"
    assert name[2] == ("MIT", "a/LICENSE") and name[5] == ("GPL-3.0", "a/b/c/COPYING") and name[15] == ("GPL-3.0", "a/b/c/COPYING") and name[17] == ("MIT", "LICENSE") and name[13] == ("MIT", "LICENSE")
    assert name[7] == ("CC-BY-NC-4.0", None) and name[8] == (None, None) and got[9, "ab/w.py"]["cosine"] is None and len(got) == len(set((i, p) for i, p, _ in rows))
    assert licenses.scan(files.limit(0)).isEmpty()


def test_license_ancestors_beyond_the_broadcast(spark, monkeypatch):
    rows = [(1, "LICENSE", "MIT", 0.9), (2, "a/LICENSE", "ISC", 0.8), (3, "a/b/c", None, None), (4, "d/e", None, None)]
    own = spark.createDataFrame(rows, "doc_id long, path string, license string, cosine double")
    first = {r["doc_id"]: r["inherited_from"] for r in licenses.inherit(own).collect()}
    monkeypatch.setattr(licenses, "BROADCAST", 0)
    assert {r["doc_id"]: r["inherited_from"] for r in licenses.inherit(own).collect()} == first == {1: None, 2: None, 3: "a/LICENSE", 4: "LICENSE"}


def test_license_query_equals_its_sql(spark):
    import duckdb

    from tessella.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = queries.op7_license_scan(spark, DATA)
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES['op7_license_scan']})").fetchall(), key=repr)
    assert any(r[4] for r in rows) and any(r[3] for r in rows)


def test_license_scan_has_no_python(spark, documents):
    plan = licenses.scan(documents.select("doc_id", F.col("source").alias("path"), "text"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# 8 urls
def test_url_rules_and_method(spark):
    urls = [(1, "http://WWW.Example.com/en/1?x#y"), (2, "https://a.example.com/en/"), (3, "http://x.com"), (4, "http://x.com/"), (5, "http://n.net/es/1"), (6, None), (7, "no scheme"), (8, "http://jackpot-live.example.net/en/1"), (9, "http://library.example.org/x"), (9, "http://library.example.org/x"), (10, "http://h?q=a/b"), (11, "http://notexample.com/en/1"), (12, "http://é" + "a" * 5000 + ".net/fr/")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("label", F.lit(2.0))
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages).collect()}
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and got[2][2:] == ("example.com/en/", "block") and got[3][:3] == ("x.com", "", None)
    assert got[4][2:] == ("com/", "allow") and got[5][2:] == ("net/es/", "block") and got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None) and got[10][:2] == ("h", "")
    assert got[8][2:] == (None, "block") and got[9][2:] == (None, "allow") and got[11][2:] == ("com/", "allow") and got[12][2:] == ("net/fr/", "block")
    assert url_filter.judge(pages).count() == len(urls) and url_filter.judge(pages.limit(0)).isEmpty()


def _dense_logistic(x, y, reg, rounds=60):
    """Ridge logistic regression by Newton's method on the dense matrix, penalising standardised coefficients, with a free intercept."""
    spread = x.std(0, ddof=1)
    z = x[:, spread > 0] / spread[spread > 0]
    kernel, n = z @ z.T, len(y)
    f = np.zeros(n)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        w = np.maximum(p * (1 - p), 1e-9)
        system = np.block([[kernel + n * reg * np.diag(1 / w), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
        solved = np.linalg.solve(system, np.append(f + (y - p) / w, 0))
        f = kernel @ solved[:n] + solved[n]
    return 1 / (1 + np.exp(-f))


def test_url_classifier_equals_a_dense_fit(spark):
    from pyspark.ml.functions import vector_to_array

    rows = url_filter.labelled(spark).coalesce(1)
    host, path = url_filter.split_url(F.col("url"))
    urls = url_filter.features(rows.select("url", host.alias("host"), path.alias("path"), "label"))
    got = url_filter.train(rows).transform(urls).select("features", "label", F.element_at(vector_to_array("probability"), 2).alias("p")).collect()
    used = sorted({i for r in got for i in r["features"].indices.tolist()})
    at = {f: i for i, f in enumerate(used)}
    x = np.zeros((len(got), len(used)))
    for i, r in enumerate(got):
        x[i, [at[f] for f in r["features"].indices.tolist()]] = r["features"].values
    dense = _dense_logistic(x, np.array([r["label"] for r in got]), 0.01)
    assert np.abs(dense - np.array([r["p"] for r in got])).max() < 1e-3


def test_url_classifier_on_words_it_has_not_seen(spark):
    """Told by shape alone, as no n-gram of the word itself is known."""
    rows, right, total = url_filter.labelled(spark).withColumn("part", F.crc32("word") % 3), 0, 0
    for i in range(3):
        model = url_filter.train(rows.where(F.col("part") != i))
        host, path = url_filter.split_url(F.col("url"))
        unseen = url_filter.features(rows.where(F.col("part") == i).select("url", host.alias("host"), path.alias("path"), "label"))
        found = model.transform(unseen).select((F.col("prediction") == F.col("label")).alias("ok")).collect()
        right, total = right + sum(r["ok"] for r in found), total + len(found)
    print(f"unseen words: {right} of {total}")
    assert right / total > 0.75


def test_url_table_holds_no_part_of_given_names(spark):
    """No four letters in a row of a hyphenated host name of the pages stand in a word of the table, and no host of the pages is one of its hosts."""
    words = [w for w in (*url_filter.UNWANTED, *url_filter.ORDINARY, *url_filter.MODIFIERS)]
    hosts = {r["host"] for r in spark.read.parquet(f"{DATA}/pages.parquet").select(url_filter.split_url(F.col("url"))[0].alias("host")).distinct().collect()}
    for host in hosts:
        assert f"{host}." not in "".join(f"{u.split('://')[1].split('/')[0]}." for u, _, _ in url_filter.labelled_rows())
        for label in host.split("."):
            for part in label.split("-") if "-" in label else ():
                assert not any(part[i : i + 4] in w for i in range(max(len(part) - 3, 1)) for w in words if len(part) > 3), (host, part)


def test_url_rules_equal_brute_force(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    for r in pages.select("page_id", "url").collect():
        url = r["url"] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]
        fit = max((x for x in url_filter.RULES if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])), key=lambda x: len(x[1]) + len(x[2]), default=None)
        row = got[r["page_id"]]
        assert (row["host"], row["path"], row["rule"]) == (host, path, fit and fit[1] + fit[2]) and (fit is None or row["verdict"] == fit[0])


# 9 embeddings
def _brute_links(rows):
    fine = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fine[i] = (label, np.array(v, np.float32).astype(float))
    links = {i: set() for i in fine}
    for i, (a, x) in fine.items():
        for j, (b, y) in fine.items():
            if i != j and a == b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links[i].add(j)
    out = {}
    for i, _, _ in rows:
        seen, stack = {i}, [i]
        while stack:
            for j in links.get(stack.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        low = min(seen) if i is not None else None
        out[i] = (len(links.get(i, ())), low, i == low)
    return out


def test_embedding_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dups, "BLOCK", 40)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    rows = [(i, [float(x) for x in centres[i % 30] + rng.normal(0, 0.06 * (i % 5), 16)], i % 3) for i in range(600)]
    rows += [(700 + i, rows[5][1], 2) for i in range(9)] + [(800, None, 1), (801, [0.0] * 16, 1), (802, [1.0, None], 1), (803, [float("nan")] * 16, 1), (804, rows[5][1], None), (805, [], 1), (806, [2.0, 4.0], 1), (807, [1.0, 2.0], 1), (None, [1.0] * 16, 1)]
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dups.near_duplicates(_vectors(spark, rows)).collect()}
    assert got == _brute_links(rows)
    twice = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (2, [0.0, 1.0], 1), (3, [0.0, 1.0], 1)]
    found = sorted(tuple(r) for r in embedding_dups.near_duplicates(_vectors(spark, twice)).collect())
    assert [r[:2] for r in found] == [(1, 2), (1, 2), (2, 1), (2, 2), (3, 1)]
    assert embedding_dups.near_duplicates(_vectors(spark, rows).limit(0)).isEmpty()


# 10 packing
def test_packing_is_exact_and_tight(spark, documents):
    rows = packing.pack(documents, "word_bpe_49k.json", 1, 4096, with_ids=True).collect()
    ordered = documents.orderBy("doc_id").collect()
    want = {r["doc_id"]: ids for r, ids in zip(ordered, _by_library([r["text"] for r in ordered], "word_bpe_49k.json", 1), strict=True)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
    for d, ids in want.items():
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        assert b"".join(bytes(r["ids"]) for r in own) == ids.tobytes() and [r["piece"] for r in own] == list(range(len(own)))
        assert all(r["length"] == 4096 for r in own[:-1]) and [r["start"] for r in own] == [4096 * i for i in range(len(own))]
    for own in by_sequence.values():
        place = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == place
            place += r["length"]
        assert place <= 4096
    assert len(by_sequence) <= 1.01 * math.ceil(sum(map(len, want.values())) / 4096) + 1


def test_packing_edges(spark):
    docs = edge_documents(spark)
    packed = packing.pack(docs, "word_bpe_49k.json", 1, 64, with_ids=True)
    assert dict(packed.dtypes)["piece"] == "int"
    rows = packed.collect()
    want = Counter((d["doc_id"], ids.tobytes()) for d, ids in zip(docs.collect(), _by_library([d["text"] for d in docs.collect()], "word_bpe_49k.json", 1), strict=True))
    for (doc, ids), n in want.items():
        own = [r for r in rows if r["doc_id"] == doc]
        assert len(own) == n * math.ceil(len(ids) / 4 / 64) and all(bytes(r["ids"]) == ids[4 * r["start"] : 4 * r["start"] + 256] and r["start"] == 64 * r["piece"] for r in own)
    for q in {r["sequence_id"] for r in rows}:
        own = sorted((r for r in rows if r["sequence_id"] == q), key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *[r["length"] for r in own[:-1]]]).tolist()
    assert sum(r["piece"] == 0 for r in rows) == docs.count() and all(1 <= r["length"] <= 64 for r in rows)
    assert packing.pack(empty_documents(spark), "word_bpe_49k.json", 1).isEmpty()


def _optimum(sizes, capacity):
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for room in sorted(set(bins)):
            if room + sizes[i] <= capacity:
                k = bins.index(room)
                bins[k] += sizes[i]
                place(i + 1, bins)
                bins[k] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


@given(st.integers(12, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c - 1), max_size=12))))
@settings(max_examples=250, deadline=None)
def test_bin_completion_is_optimal(case):
    capacity, sizes = case
    got, proved = packing.bin_completion(sizes, capacity, None)
    assert sorted(i for b in got for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= capacity for b in got)
    assert proved and len(got) == _optimum(sizes, capacity) >= packing.least_sequences(sizes, capacity)


def test_bin_completion_beats_best_fit_and_says_what_it_proved():
    sizes = [30, 9, 23, 26, 8, 17, 8, 8, 6, 40]
    assert len(packing.bin_completion(sizes, 60)[0]) == 3 and packing.bin_completion(sizes, 60)[1]
    rng = random.Random(1)
    cases = [[rng.randint(12, 50) for _ in range(40)] for _ in range(60)]
    found = [packing.bin_completion(c, 100) for c in cases]
    assert all(len(b) <= len(packing.best_fit_decreasing(c, 100)) for (b, _), c in zip(found, cases, strict=True)) and sum(p for _, p in found) > 50
    assert not packing.bin_completion([51, 27, 27, 27, 23, 23, 26, 26, 24, 46] * 7, 100, 5)[1] or len(packing.bin_completion([51, 27, 27, 27, 23, 23, 26, 26, 24, 46] * 7, 100, 5)[0]) == 21


def test_groups_lose_no_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 64)
    docs = spark.createDataFrame([(i, "word " * (i % 9 + 1)) for i in range(3000)], "doc_id long, text string")
    rows = packing.pack(docs, "word_bpe_49k.json", 1, 64).collect()
    assert len(rows) == 3000 and len({r["sequence_id"] for r in rows}) <= math.ceil(sum(r["length"] for r in rows) / 64) + 1
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 64
