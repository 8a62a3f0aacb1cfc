from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions.aggregates import first_by_hash
from tessella.operators import affinity, candidates, categorize, clustering, compose, incremental, learning, mdl, meta_tree, name_qgrams, pairsim, scoring
from tessella.operators.value_tokens import words
from tessella.plans import model
from tessella.sources import ingest, state
from tests.conftest import DATA


def test_affinity(spark):
    rows = spark.createDataFrame([(1, 1, 0.8, 0.5), (1, 1, 0.9, 1.0), (2, 1, 1.0, 0.5), (2, 3, 0.1, 0.1)], "local_id long, global_id long, confidence double, authority double")
    got = {(r[0], r[1]): r[2] for r in affinity.affinities(rows).collect()}
    assert got[1, 1] == 1.0 and got[2, 1] == 0.5
    assert {(r[0], r[1]) for r in affinity.training_mappings(rows).collect()} == {(1, 1), (2, 1)}


def test_name_matcher_small(spark):
    fields = spark.createDataFrame([(1, 1, "zip code"), (1, 2, "city")], "source_id long, field_id long, name string")
    attributes = spark.createDataFrame([(10, "ZIP"), (11, "CITY NAME")], "global_id long, name string")
    known = spark.createDataFrame([(2, 11, 0.5)], "local_id long, global_id long, affinity double")
    got = {(r["field_id"], r["global_id"]): round(r["score"], 6) for r in name_qgrams.scores(fields, attributes, known).collect()}
    assert {k: v for k, v in got.items() if v} == {(1, 10): 0.612372, (1, 11): 0.081951, (2, 11): 0.463588}


def test_name_matcher_tables(spark):
    got = name_qgrams.scores(model.fields(spark), model.attributes(spark), model.affinity(spark, model.SURE))
    best = {r["field_id"]: (r["global_id"], round(r["score"], 4)) for r in got.orderBy("score").collect()}
    names = {i: model.ATTRIBUTES[g - 1] for i, (g, _) in best.items()}
    by_name = {c: (names[i], best[i][1]) for i, _, c in model.FIELDS}
    assert by_name["c_name"] == ("NAME", 0.4556) and by_name["c_nationkey"] == ("NATIONKEY", 0.6668) and by_name["p_retailprice"] == ("RETAILPRICE", 0.7636) and by_name["n_regionkey"] == ("REGIONKEY", 0.6861)


def test_mdl(spark):
    cells = spark.createDataFrame([(1, 1, v) for v in ["MA"] * 3 + ["NH", "XYZ"]], "source_id long, field_id long, value string")
    local = mdl.local_dictionary(cells)
    dictionary = spark.createDataFrame([(5, "MA", 1.0), (5, "NH", 0.5), (5, "TEXAS", 1.0)], "global_id long, value string, affinity double")
    row = mdl.description_length(local, dictionary).first()
    assert [round(row[c], 6) for c in ("f", "term1", "term2", "term3")] == [0.7, 1.109474, 5.28, 0.587954]
    assert round(mdl.scores(local, dictionary).first()["score"], 6) == 0.603555


def test_composite(spark):
    raw = spark.createDataFrame([(1, 1, "qgrams", 7, 0.5), (1, 1, "mdl", 7, 0.8), (1, 1, "val_qgrams", 7, 1.0), (1, 2, "mdl", 7, 0.3), (1, 2, "mdl", 8, 0.3)], "source_id long, field_id long, method_name string, match_id long, score double")
    methods = compose.default_methods(spark)
    got = {(r["field_id"], r["match_id"]): round(r["score"], 6) for r in compose.composite(raw, methods).collect()}
    assert got == {(1, 7): 0.89, (2, 7): 0.09, (2, 8): 0.09}
    assert {(r["field_id"], r["match_id"]): r["score"] for r in compose.votes(raw, methods).collect()} == {(1, 7): 3.0, (2, 7): 1.0, (2, 8): 1.0}
    assert compose.replace_results(raw, raw).count() == raw.count()


def test_meta_tree(spark):
    raw = spark.createDataFrame([(1, f, m, a, 0.9 if a == f % 3 else 0.1) for f in range(20) for a in range(3) for m in compose.METHODS], "source_id long, field_id long, method_name string, match_id long, score double")
    mappings = spark.createDataFrame([(f, f % 3) for f in range(20)], "local_id long, global_id long")
    rows = meta_tree.labelled_features(raw, mappings)
    got = meta_tree.measures(meta_tree.stats(meta_tree.classify(meta_tree.train(rows), rows))).first()
    assert (got["recall"], got["precision"], got["f"]) == (1.0, 1.0, 1.0)


def test_band_join_matches_brute_force(spark):
    values = [10.0, 12.0, 15.0, 15.0, -3.0, 0.0, 2.9999, 3.0]
    rows = spark.createDataFrame([("c", i, 1, v) for i, v in enumerate(values)], "cat string, entity_id long, att_id long, v double")
    limits = spark.createDataFrame([("c", 1, -3.0)], "cat string, att_id long, threshold double")
    got = {(r["e1"], r["e2"]) for r in candidates.band_pairs(rows, limits).collect()}
    assert got == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if abs(values[i] - values[j]) <= 3}


def test_vectors_and_prefix(spark):
    tokens = spark.createDataFrame([("c", e, 1, t) for e, ts in enumerate(["a b b d", "a c", "d d e", "f"]) for t in ts.split()], "cat string, entity_id long, att_id long, token string")
    idf = candidates.idf(candidates.document_counts(tokens), candidates.tag_frequency(tokens))
    vecs = candidates.vectors(tokens, idf)
    assert all(abs(r[0] - 1) < 1e-9 for r in vecs.groupBy("entity_id").agg(F.sum(F.col("w") * F.col("w"))).select("sum((w * w))").collect())
    short = candidates.prefix_filter(vecs, spark.createDataFrame([("c", 1, 0.9)], "cat string, att_id long, threshold double"))
    assert {r[0] for r in short.select("entity_id").distinct().collect()} == {r[0] for r in vecs.select("entity_id").distinct().collect()}
    assert candidates.prefix_filter(vecs, spark.createDataFrame([("c", 1, None)], "cat string, att_id long, threshold double")).count() == vecs.count()


def test_match_probability(spark):
    pairs = spark.createDataFrame([("c", 1, 2)], "cat string, e1 long, e2 long")
    sims = spark.createDataFrame([("c", 1, 2, 1, 0.7)], "cat string, e1 long, e2 long, att_id long, sim double")
    features = spark.createDataFrame([("c", 1, None, None, 0.1, 0.5), ("c", 2, None, None, 0.2, 0.6), ("c", 1, 0.5, 1.0, 0.8, 0.1)], "cat string, att_id long, t1 double, t2 double, f_m double, f_u double")
    prior = spark.createDataFrame([("c", 0.01)], "cat string, dup_prob double")
    row = scoring.category_probabilities(pairs, sims, features, prior).first()
    assert (round(row["m"], 6), round(row["u"], 6)) == (0.0016, 0.0594)
    assert round(scoring.probabilities(scoring.category_probabilities(pairs, sims, features, prior)).first()["probability"], 6) == 0.026230


def test_zero_fill(spark):
    pairs = spark.createDataFrame([("c", 1, 2)], "cat string, e1 long, e2 long")
    vecs = spark.createDataFrame([("c", 1, 1, "x", 1.0), ("c", 2, 1, "y", 1.0)], "cat string, entity_id long, att_id long, token string, w double")
    vecs = scoring.packed_vectors(vecs)
    sims = scoring.text_similarities(pairs, vecs)
    assert [tuple(r) for r in scoring.zero_fill(pairs, sims, vecs.select("cat", "entity_id", "att_id")).collect()] == [("c", 1, 2, 1, 0.0)]


def test_clustering_partitions_and_stops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (6, 7), (7, 8)], "e1 long, e2 long")
    empty = spark.createDataFrame([], "entity_id long, cluster_id long")
    got = clustering.cluster(empty, edges, edges)
    assert got.count() == 8 and got.select("entity_id").distinct().count() == 8
    label = {r["entity_id"]: r["cluster_id"] for r in got.collect()}
    assert label[1] == label[2] == label[3] and label[4] == label[5] and len(set(label.values())) >= 3
    again = clustering.cluster(got, edges, edges.limit(0))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in got.collect()}
    options = clustering.clusterings(edges, 2)
    assert clustering.disagreement(clustering.least_disagreement(options, edges), edges).first()["missing"] >= 0


def test_merge_rule_needs_two_cross_edges(spark):
    state_ = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "entity_id long, cluster_id long")
    one = spark.createDataFrame([(1, 2), (3, 4), (1, 3)], "e1 long, e2 long")
    two = one.union(spark.createDataFrame([(2, 4)], "e1 long, e2 long"))
    assert clustering.mergeable(state_, one).isEmpty() and clustering.mergeable(state_, two).count() == 2


def test_learning_from_labels_and_clustering(spark):
    entities = spark.createDataFrame([("c", i, i // 2) for i in range(60)], "cat string, entity_id long, global_id long")
    dups = learning.duplicate_pairs(entities)
    assert dups.count() == 30
    types = spark.createDataFrame([(1, "TEXT")], "att_id long, type string")
    sims = dups.withColumn("att_id", F.lit(1).cast("long")).withColumn("sim", 0.7 + F.col("e1") % 7 / 25)
    rnd = learning.random_pairs(entities, 60).join(dups, ["cat", "e1", "e2"], "left_anti").withColumn("att_id", F.lit(1).cast("long")).withColumn("sim", (F.col("e1") * 7 + F.col("e2")) % 60 / 100)
    features, thresholds, prior = learning.learn_from_clustering(entities, sims, rnd, types)
    assert features.where("t1 is null").count() == 1 and features.where("t1 is not null").count() == 4 and thresholds.count() == 1
    assert abs(prior.first()["dup_prob"] - min(1 - 1e-9, 100 * 30 / (60 * 59 / 2))) < 1e-9
    labels = dups.withColumn("label", F.lit("YES")).unionByName(rnd.select("cat", "e1", "e2").withColumn("label", F.lit("no")))
    features, thresholds, prior = learning.learn_from_labels(labels, sims.unionByName(rnd), rnd, types)
    assert features.count() == 5 and 0 <= prior.first()["dup_prob"] <= 1 and -1 <= thresholds.first()["threshold"] <= 1.1


def test_pair_weights(spark):
    sims = spark.createDataFrame([(1, 1, 2, 0.8), (1, 1, 3, 0.2)], "field_id long, a long, b long, sim double")
    matches = spark.createDataFrame([(2, 1)], "entity_a long, entity_b long")
    assert round(pairsim.field_weights(sims, matches).first()["weight"], 6) == 4.0
    many = spark.createDataFrame([(1, i, i + 1000, 0.8) for i in range(25)] + [(1, 5000, 6000, 0.2)], "field_id long, a long, b long, sim double")
    known = spark.createDataFrame([(i, i + 1000) for i in range(25)], "entity_a long, entity_b long")
    assert round(pairsim.field_weights(many, known, 10.0).first()["weight"], 6) == 8.5


@pytest.mark.parametrize("hot", [1, 3, 10])
@pytest.mark.parametrize("bias", [None, 5.0])
def test_weights_without_pairs_equal_weights_over_pairs(spark, hot, bias):
    rng = random.Random(hot)
    letters = "abcdefghijklmnopqrst"
    rows = [(e, f, " ".join(rng.choices(letters, k=rng.randint(1, 4)))) for e in range(80) for f in (1, 2) if rng.random() < 0.9]
    rows += [(e, 3, "the same") for e in range(40)] + [(1, 4, "alone"), (2, 5, None), (3, 5, "")]
    toks = pairsim.tokens(spark.createDataFrame(rows, "entity_id long, field_id long, value string")).checkpoint()
    matches = spark.createDataFrame([(e + 1, e) for e in range(0, 60, 2)] * 2 + [(7, 7), (500, 1)], "entity_a long, entity_b long")
    expected = {r["field_id"]: r["weight"] for r in pairsim.field_weights(pairsim.field_cosines(toks), matches, bias).collect()}
    got = {r["field_id"]: r["weight"] for r in pairsim.token_field_weights(toks, matches, bias, hot).collect()}
    assert set(got) == set(expected) == {1, 2, 3}
    assert all(got[f] == pytest.approx(expected[f], rel=1e-9) for f in expected)
    none = pairsim.token_field_weights(toks.limit(0), matches, bias, hot)
    assert none.count() == 0


def test_categories(spark):
    # The x tokens link the two groups: an entity that shares no token with a centroid is never the next one.
    rows = [(e, 1, t) for e in range(12) for t in (("red", "rose", "thorn") if e < 6 else ("blue", "sea", "wave")) + (f"x{e % 2}",)]
    tokens = spark.createDataFrame(rows, "entity_id long, att_id long, token string")
    found = categorize.build(tokens, 2, rounds=3)
    fractions = categorize.token_fractions(tokens)
    label = {r["entity_id"]: r["category_id"] for r in categorize.assign(tokens, fractions, found).collect()}
    assert len({label[e] for e in range(6)}) == 1 and len({label[e] for e in range(6, 12)}) == 1 and label[0] != label[6]


@pytest.mark.parametrize("batch", [1, 5, 512])
def test_seeds_equal_one_choice_after_the_other(spark, batch, monkeypatch):
    rng = random.Random(batch)
    rows = [(e, 1, f"t{t}", rng.random()) for e in range(90) for t in rng.sample(range(60), 3)] + [(1000, 1, "lonely", 1.0)]
    vectors = categorize.unit(spark.createDataFrame(rows, "entity_id long, att_id long, token string, w double"), ["entity_id"]).checkpoint()
    if batch == 5:
        monkeypatch.setattr(categorize, "SEED_FEATURES", 7)
    own: dict[int, dict[str, float]] = {}
    for r in vectors.collect():
        own.setdefault(r["entity_id"], {})[r["token"]] = r["w"]
    digest = {e: hashlib.md5(f"cat{e}".encode()).hexdigest() for e in own}
    chosen = [min(own, key=lambda e: (digest[e], e))]
    while len(chosen) < 12:
        sims = {e: max((sum(v[t] * own[c][t] for t in v.keys() & own[c].keys()) for c in chosen if v.keys() & own[c].keys()), default=None) for e, v in own.items() if e not in chosen}
        chosen.append(min((s + 0.07 * int(digest[e][:8], 16) / 2**32, e) for e, s in sims.items() if s is not None)[1])
    got = {r["category_id"]: r["entity_id"] for r in categorize.initial_entities(vectors, 12, batch=batch).collect()}
    assert [got[i + 1] for i in range(12)] == chosen and 1000 not in chosen
    assert categorize.initial_entities(vectors.limit(0), 3).count() == 0


def test_stored_categories(spark, tmp_path):
    rows = [(e % 2, e, 1, t) for e in range(12) for t in (("red", "rose", "thorn") if e < 6 else ("blue", "sea", "wave")) + (f"x{e % 2}",)]
    tokens = spark.createDataFrame(rows, "source_id long, entity_id long, att_id long, token string")
    store = state.StateStore(spark, str(tmp_path / "cat"))
    categorize.build_stored(store, tokens.drop("source_id"), 2, rounds=3)
    first = {tuple(r) for r in categorize.categorize_sources(store, tokens).collect()}
    assert {e for e, *_ in first} == set(range(12)) and store.parts("entity_categories") == ["source0", "source1"]
    fewer = tokens.where("source_id = 1 and entity_id < 6").drop("source_id")
    assert {r["entity_id"] for r in categorize.categorize_source(store, fewer, 1).collect()} == {1, 3, 5}
    assert {r["entity_id"] for r in store.read("entity_categories").collect()} == {0, 2, 4, 6, 8, 10, 1, 3, 5}
    assert categorize.categorize_source(store, fewer.limit(0), 7).count() == 0
    categorize.build_stored(store, tokens.drop("source_id"), 2, rounds=1)
    assert not store.exists("entity_categories")
    store.clean("categories")
    assert not store.exists("category_features") and not store.exists("category_tokens")


def test_ingest_is_idempotent_and_keeps_keys_apart(spark):
    data = spark.createDataFrame([(1, 5, "a", "x"), (2, 5, "a", "y"), (1, 6, "b", ""), (1, 7, "b", None), (1, 8, "c", "z" * 1300), (1, 9, "c", "z" * 1299)], "source_id long, entity_id long, name string, value string")
    got = ingest.from_staged(data)
    assert got.cells.count() == 4 and got.entities.count() == 4 and got.sources.count() == 2
    assert {tuple(r) for r in ingest.from_staged(data).cells.collect()} == {tuple(r) for r in got.cells.collect()}
    wide = spark.createDataFrame([("s", 1, "v", None), ("t", 1, "", 2.5)], "src string, id int, a string, b double")
    assert {tuple(r) for r in ingest.wide_cells(wide, "w", ["a", "b"], "src", "id").collect()} == {("w/s", "a", "1", "v"), ("w/t", "b", "1", "2.5")}


def test_state_store(spark, tmp_path):
    store = state.StateStore(spark, str(tmp_path / "state"))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "source_id long, v string")
    store.write("t", rows)
    store.replace("t", spark.createDataFrame([(2, "c")], "source_id long, v string"), ["source_id"])
    store.replace("t", spark.createDataFrame([(2, "c")], "source_id long, v string"), ["source_id"])
    assert {tuple(r) for r in store.read("t").collect()} == {(1, "a"), (2, "c")}
    store.set_config("cat_k", "3")
    assert {r["name"]: r["value"] for r in store.config().collect()}["cat_k"] == "3"
    store.write("field_grams", rows)
    store.unload_local()
    assert not store.exists("field_grams") and store.exists("t")
    store.put("p", "source1", rows.where("source_id = 1"))
    store.put("p", "source2", rows.where("source_id = 2"))
    store.put("p", "source2", rows.where("source_id = 2"))
    assert store.read("p").count() == 2 and store.read("p", "source1").count() == 1 and store.parts("p") == ["source1", "source2"]
    store.append("p", rows)
    assert store.read("p").count() == 4 and store.write("p", rows).count() == 2 and store.parts("p") == ["all"]
    for name in ("inserted_vectors", "clusters", "edges"):
        store.put(name, "source1", rows)
    store.clean("pairs")
    assert not any(map(store.exists, ("inserted_vectors", "clusters", "edges")))


def test_label_sink(spark):
    questions = spark.createDataFrame([(1, 2, 0.5, None), (3, 4, 0.4, None)], "e1 long, e2 long, sim double, human_label string")
    out, matches = state.label_pair(questions, spark.createDataFrame([(1, 2, "YES")], "e1 long, e2 long, human_label string"))
    assert {(r["e1"], r["human_label"]) for r in out.collect()} == {(1, "Yes"), (3, None)} and matches.count() == 1


def test_incremental_source_is_idempotent(spark, tmp_path):
    store = state.StateStore(spark, str(tmp_path / "dedup"))
    types = spark.createDataFrame([(1, "TEXT"), (2, "REAL")], "att_id long, type string")
    features = spark.createDataFrame([("c", 1, None, None, 0.1, 0.1), ("c", 1, 0.0, 0.5, 0.1, 0.9), ("c", 1, 0.5, 1.1, 0.9, 0.001)], "cat string, att_id long, t1 double, t2 double, f_m double, f_u double")
    limits = spark.createDataFrame([("c", 1, 0.1), ("c", 2, -1.0)], "cat string, att_id long, threshold double")
    prior = spark.createDataFrame([("c", 0.5)], "cat string, dup_prob double")
    entities = spark.createDataFrame([(i, 1 if i < 10 else 2) for i in range(20)], "entity_id long, source_id long")

    def cells(low: int) -> list:
        return [("c", low + i, 1, f"alpha{i // 2} beta{i // 2}") for i in range(10)]

    def add(source: int):
        rows = spark.createDataFrame(cells(10 * (source - 1)), "cat string, entity_id long, att_id long, value string")
        return incremental.add_source(store, rows, features, limits, prior, types, entities, source, words)

    add(1)
    first = {tuple(r) for r in add(2).collect()}
    assert len({c for _, c in first}) == 5
    again = {tuple(r) for r in add(2).collect()}
    assert {e for e, _ in again} == {e for e, _ in first} and store.read("edges").distinct().count() == store.read("edges").count()


def test_all_sources(spark, tmp_path):
    types = spark.createDataFrame([(1, "TEXT"), (2, "REAL")], "att_id long, type string")
    features = spark.createDataFrame([("c", 1, None, None, 0.1, 0.1), ("c", 1, 0.0, 0.5, 0.1, 0.9), ("c", 1, 0.5, 1.1, 0.9, 0.001)], "cat string, att_id long, t1 double, t2 double, f_m double, f_u double")
    limits = spark.createDataFrame([("c", 1, 0.1), ("c", 2, -1.0)], "cat string, att_id long, threshold double")
    prior = spark.createDataFrame([("c", 0.5)], "cat string, dup_prob double")
    entities = spark.createDataFrame([(i, i // 10) for i in range(20)], "entity_id long, source_id long")
    cells = spark.createDataFrame([("c", i, 1, f"alpha{i % 10} beta{i % 10}") for i in range(20)], "cat string, entity_id long, att_id long, value string")
    store = state.StateStore(spark, str(tmp_path / "all"))
    got = incremental.add_all_sources(store, cells, features, limits, prior, types, entities, words, sample=100)
    assert len({r["cluster_id"] for r in got.collect()}) == 10 and store.parts("edges") == ["source0", "source1"] and "sample" in store.parts("token_counts")


def test_mapping_drivers(spark, tmp_path):
    from tessella.operators import mapping

    fields, attributes = model.fields(spark), model.attributes(spark)
    cells = model.cells(spark, DATA)
    gold = spark.createDataFrame([(12, 5), (13, 6), (14, 7), (15, 8)], "field_id long, tag_id long")
    dictionary = spark.createDataFrame([(6, "STANDARD BRASS")], "global_id long, value string")
    by_method, composite, votes = mapping.test_mapping(state.StateStore(spark, str(tmp_path / "map")), cells, fields, attributes, model.mappings(spark), dictionary, gold, [3], ("qgrams", "mdl"), words)
    assert {r["method_name"] for r in by_method.collect()} <= {"qgrams", "mdl"} and composite.first()["total"] >= 4 and votes.count() == 1


def test_sinks(spark):
    answers = spark.createDataFrame([(1, 2, 80.0, True), (3, 4, 50.0, False)], "local_id long, global_id long, pct double, is_match boolean")
    mapped, rejected = ingest.answer_rows(answers, 7)
    assert mapped.first()["confidence"] == 0.8 and [tuple(r) for r in rejected.collect()] == [(3, 4, 7)]
    proposed = ingest.suggestion_rows(spark.createDataFrame([(" COLOR ", 5, "?")], "name string, reference_field_id long, comment string"), "me").first()
    assert proposed["name"] == "COLOR" and proposed["suggested_at"] is not None
    staged = spark.createDataFrame([(1, "a", "X"), (1, "b", None)], "source_id long, name string, tag_code string")
    data = spark.createDataFrame([(1, 1, "a", "v"), (1, 1, "b", "w")], "source_id long, entity_id long, name string, value string")
    got, attributes, known = ingest.training_load(staged, data)
    assert got.cells.count() == 2 and attributes.count() == 1 and known.count() == 1


def test_stream_ingest(spark, tmp_path):
    from tessella.streaming import ingest as streaming

    place = tmp_path / "in"
    spark.createDataFrame([(1, 5, "a", "x"), (1, 6, "a", "y")], streaming.STAGED).write.json(str(place))
    store = state.StateStore(spark, str(tmp_path / "stream"))
    for _ in range(2):
        streaming.ingest_stream(spark.readStream.schema(streaming.STAGED).json(str(place)), store, str(tmp_path / "check")).awaitTermination(120)
    assert store.read("local_data").count() == 2 and store.read("local_fields").count() == 1
    spark.createDataFrame([(1, 5, "a", "another value"), (1, 7, "b", "z")], streaming.STAGED).write.mode("append").json(str(place))
    streaming.ingest_stream(spark.readStream.schema(streaming.STAGED).json(str(place)), store, str(tmp_path / "check")).awaitTermination(120)
    got = streaming.ingested(store)
    assert sorted(r["value"] for r in got.cells.collect()) == ["another value", "x", "y", "z"] and got.fields.count() == 2 and got.entities.count() == 3


def test_plans_push_filters_to_the_scan(spark):
    plan = model.table(spark, DATA, "customer").where("c_nationkey = 3").select("c_name")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_nationkey), EqualTo(c_nationkey,3)]" in plan and "c_acctbal" not in plan


@pytest.mark.parametrize("floor", [0.02, 0.3, 0.9])
def test_scores_above_equal_all_scores_above(spark, floor):
    from tessella.operators import distributions

    rng = random.Random(5)
    rows = [(i, rng.choice([2, 3, 10, 500, 10**6]), rng.choice([0.0, 1e-9, 5.0, -40.0, 1e12]) + rng.gauss(0, rng.choice([1e-6, 0.1, 3.0])), rng.choice([0.0, 1e-12, 0.5, 4.0, 1e9])) for i in range(60)]
    rows += [(100, 5, 1e300, 1.0), (101, 5, 1e300, 1.0), (102, *rows[1][1:])]
    stats = spark.createDataFrame(rows, "field_id long, n long, mean double, variance double")
    glob = stats.withColumnsRenamed({"field_id": "global_id"}).withColumn("global_id", F.col("global_id") % 40).withColumn("affinity", (F.col("global_id") % 5) / 4.0)
    expected = {tuple(r)[:2]: r["score"] for r in distributions.scores_of(stats, glob).where(F.col("score") >= floor).collect()}
    got = [tuple(r) for r in distributions.scores_above(stats, glob, floor).collect()]
    assert len(got) == len(expected) > 0 and all(s == pytest.approx(expected[f, g], rel=1e-12) for f, g, s in got)
    # The whole join tests every row with every row.
    assert distributions.comparisons_above(stats, glob, floor).count() < stats.count() * glob.count() / 4
    assert distributions.scores_above(stats.limit(0), glob, floor).count() == 0 and distributions.scores_above(stats, glob, 1.5).count() == 0


def test_intervals_meet_once(spark):
    from tessella.operators import distributions

    rng = random.Random(9)
    rows = [(i, low, low + w) for i in range(120) for low, w in [(rng.uniform(-50, 50), rng.choice([0.0, 1e-7, 0.4, 1.0, 7.0, 64.0]))]] + [(200, 0.5, 1.5), (201, 1.5, 2.5), (202, -0.5, 0.5), (203, -0.0, 0.0)]
    frame = spark.createDataFrame(rows, "id long, low double, high double")
    got = sorted((r["l_id"], r["r_id"]) for r in distributions.near_pairs(frame, frame).collect())
    assert got == sorted((a, b) for a, la, ha in rows for b, lb, hb in rows if max(la, lb) <= min(ha, hb))


def test_dist_scores_are_p_values(spark):
    from tessella.operators import distributions

    cells = spark.createDataFrame([(f, str(v + f)) for f in (1, 2) for v in range(20)] + [(3, "x"), (4, "1")], "field_id long, value string")
    known = spark.createDataFrame([(1, 9, 0.5)], "local_id long, global_id long, affinity double")
    got = {r["field_id"]: r["score"] for r in distributions.scores(cells, known).collect()}
    assert math.isclose(got[1], 0.5) and 0 < got[2] < 0.5 and set(got) == {1, 2}


@pytest.mark.parametrize("empty", [True])
def test_empty_tables(spark, empty):
    nothing = spark.createDataFrame([], "cat string, entity_id long, att_id long, value string")
    assert candidates.entity_values(nothing).isEmpty() and candidates.attribute_types(nothing).isEmpty()
    assert clustering.cluster(spark.createDataFrame([], "entity_id long, cluster_id long"), *[spark.createDataFrame([], "e1 long, e2 long")] * 2).isEmpty()


@pytest.mark.parametrize("block", [2048, 3, 1])
def test_token_pairs_are_dealt_into_blocks(spark, block):
    rng = random.Random(block)
    rows = sorted({("c" if i % 2 else None, e, a, t, 1.0) for i in range(400) for e, a, t in [(rng.randint(0, 40), rng.randint(1, 2), rng.choice("abcdefgh"))]}, key=repr)
    vecs = spark.createDataFrame(rows, "cat string, entity_id long, att_id long, token string, w double")
    held = {}
    for cat, e, a, t, _ in rows:
        held.setdefault((cat, a, t), set()).add(e)
    want = {(k[0], x, y) for k, es in held.items() for x in es for y in es if x < y and k[0] is not None}
    assert sorted(map(tuple, candidates.token_pairs(vecs, block).collect())) == sorted(want)
    fresh, old = vecs.where("entity_id % 3 = 0"), vecs.where("entity_id % 3 <> 0")
    two = {(k[0], x, y) for k, es in held.items() for x in es for y in es if x % 3 == 0 and y % 3 and k[0] is not None}
    assert sorted(map(tuple, candidates.token_pairs_two_way(fresh, old, block).collect())) == sorted(two)
    assert candidates.token_pairs(vecs.limit(0), block).isEmpty()


@pytest.mark.parametrize(("pairs_of", "bytes_of"), [(200_000, 1 << 26), (20, 1 << 26), (200_000, 300)])
def test_pair_facts_in_cells_of_any_size(spark, pairs_of, bytes_of):
    rng = random.Random(8)
    vecs, nums = {}, {}
    for cat in ("c", "d"):
        for e in range(30):
            for a in (1, 2):
                if rng.random() < 0.8:
                    vecs[cat, e, a] = {rng.choice("abcdefghij"): rng.random() for _ in range(rng.randint(1, 5))}
            for _ in range(rng.randint(0, 3)):
                nums.setdefault((cat, e, 3), []).append(round(rng.uniform(-5, 5), 3))
    pairs = sorted({(cat, x, y) for cat in ("c", "d") for _ in range(150) for x, y in [sorted((rng.randint(0, 33), rng.randint(0, 33)))] if x < y})
    packed = scoring.packed_vectors(spark.createDataFrame([(*k, t, w) for k, v in vecs.items() for t, w in v.items()], "cat string, entity_id long, att_id long, token string, w double"))
    numbers = spark.createDataFrame([(*k, v) for k, vs in nums.items() for v in vs], "cat string, entity_id long, att_id long, v double")
    frame = spark.createDataFrame(pairs, "cat string, e1 long, e2 long")
    want, shared = {}, set()
    for cat, x, y in pairs:
        for a in (1, 2):
            v, w = vecs.get((cat, x, a)), vecs.get((cat, y, a))
            if v and w:
                want[cat, x, y, a] = sum(c * w.get(t, 0) for t, c in v.items())
                if set(v) & set(w):
                    shared.add((cat, x, y, a))
        if (cat, x, 3) in nums and (cat, y, 3) in nums:
            want[cat, x, y, 3] = max(-abs(p - q) for p in nums[cat, x, 3] for q in nums[cat, y, 3])
    got = {(r["cat"], r["e1"], r["e2"], s["att_id"]): s["sim"] for r in scoring.pair_facts(frame, scoring.facts(packed, numbers), cell_pairs=pairs_of, cell_bytes=bytes_of).collect() for s in r["sims"]}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert {tuple(r)[:4] for r in scoring.text_similarities(frame, packed).collect()} == shared
    features = spark.createDataFrame([("c", 1, None, None, 0.1, 0.5), ("c", 1, 0.0, 0.5, 0.3, 0.6), ("c", 1, 0.5, 9.0, 0.8, 0.1), ("c", 3, None, None, 0.2, 0.4), ("c", 3, -1.0, 0.1, 0.7, 0.2), ("d", 2, 0.1, 1.0, 0.4, None)], "cat string, att_id long, t1 double, t2 double, f_m double, f_u double")
    prior = spark.createDataFrame([("c", 0.01), ("d", 0.2)], "cat string, dup_prob double")
    sims = scoring.similarities(frame, packed, numbers).join(features.select("cat", "att_id").distinct(), ["cat", "att_id"], "left_semi")
    plain = {tuple(r)[:2]: r["probability"] for r in scoring.probabilities(scoring.category_probabilities(frame, sims, features, prior)).collect()}
    fused = {tuple(r)[:2]: r["probability"] for r in scoring.score_pairs(frame, packed, numbers, features, prior).collect()}
    assert set(plain) == set(fused) and all(abs(plain[k] - fused[k]) < 1e-12 for k in plain)


def test_samples_by_hash_equal_a_sort(spark):
    rows = [(("a", "b", None)[i % 3], i // 2 % 150) for i in range(900)]
    frame = spark.createDataFrame(rows, "k string, v long")
    for k in (1, 7, 100, 5000):
        hashed = F.md5(F.col("v").cast("string"))
        got = first_by_hash(frame, ["k"], k, hashed, F.col("v")).collect()
        for key in ("a", "b", None):
            order = sorted((v for q, v in rows if q == key), key=lambda v: (hashlib.md5(str(v).encode()).hexdigest(), v))[:k]
            assert [r["v"] for r in sorted((r for r in got if r["k"] == key), key=lambda r: r["place"])] == order
    assert categorize.entity_sample(spark.range(500).select(F.col("id").alias("entity_id")), 120).count() == 120


def _plain_rounds(edges, seed, aggressiveness=2.0, rounds=None):
    """The merge rounds over all entity edges, in plain Python."""
    label = {e: e for p in edges for e in p}
    edges = {tuple(sorted(p)) for p in edges}
    md5 = lambda *v: hashlib.md5("|".join(map(str, v)).encode()).hexdigest()
    round_ = 0
    while rounds is None or round_ < rounds:
        size, cross = {}, {}
        for e in label:
            size[label[e]] = size.get(label[e], 0) + 1
        for a, b in edges:
            if label[a] != label[b]:
                k = tuple(sorted((label[a], label[b])))
                cross[k] = cross.get(k, 0) + 1
        dense = [(a, b) for (a, b), n in cross.items() if n >= size[a] * size[b] / aggressiveness]
        if not dense:
            return label
        wish, number = {}, (seed << 20) + round_
        for a, b in dense + [(b, a) for a, b in dense]:
            wish.setdefault(a, []).append(b)
        picked = {}
        for a, bs in wish.items():
            b = min(bs, key=lambda x: md5(number, a, x))
            picked.setdefault(b, []).append(a)
        to = {}
        for b, aa in picked.items():
            to[min(aa, key=lambda x: md5(number, b, x))] = b
        final = {a: min(a, b) if to.get(b) == a else b for a, b in to.items()}
        label = {e: final.get(c, c) for e, c in label.items()}
        round_ += 1
    return label


def test_contracted_rounds_equal_plain_rounds(spark):
    rng = random.Random(12)
    edges = sorted({tuple(sorted(rng.sample(range(g * 9, g * 9 + 9), 2))) for g in range(8) for _ in range(22)} | {tuple(sorted(rng.sample(range(72), 2))) for _ in range(15)})
    frame = spark.createDataFrame(edges, "e1 long, e2 long")
    empty = spark.createDataFrame([], "entity_id long, cluster_id long")
    for rounds in (1, 3, None):
        got = {r["entity_id"]: r["cluster_id"] for r in clustering.cluster(empty, frame, frame, seed=2, rounds=rounds).collect()}
        assert got == _plain_rounds(edges, 2, rounds=rounds)
    many = clustering.clusterings(frame, 3).checkpoint()
    for seed in (1, 2, 3):
        assert {r["entity_id"]: r["cluster_id"] for r in many.where(F.col("seed") == seed).collect()} == _plain_rounds(edges, seed)
    costs = {r["seed"]: (r["missing"], r["crossing"]) for r in clustering.disagreements(many, frame).collect()}
    for seed in (1, 2, 3):
        label = _plain_rounds(edges, seed)
        crossing = sum(label[a] != label[b] for a, b in edges)
        sizes = {}
        for c in label.values():
            sizes[c] = sizes.get(c, 0) + 1
        assert costs[seed] == (sum(n * (n - 1) // 2 for n in sizes.values()) - (len(edges) - crossing), crossing)
    best = min(costs, key=lambda k: (sum(costs[k]), k))
    assert {tuple(r) for r in clustering.least_disagreement(many, frame).collect()} == set(_plain_rounds(edges, best).items())


def test_transactions_show_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "atomic")
    store = state.StateStore(spark, root)
    rows = lambda v: spark.createDataFrame([(1, v)], "k long, v string")
    tables = ("edges", "scored_pairs", "clusters")
    with store.transaction():
        for t in tables:
            store.put(t, "source1", rows("old"))
    seen = lambda: [state.StateStore(spark, root).read(t).first()["v"] for t in tables]
    for stop in range(3):
        with pytest.raises(ZeroDivisionError), store.transaction():
            for i, t in enumerate(tables):
                if i == stop:
                    1 / 0  # noqa: B018
                store.put(t, "source1", rows("new"))
                assert store.read(t).first()["v"] == "new" and seen() == ["old"] * 3
        assert seen() == ["old"] * 3
    # A manifest whose writer was lost half-way counts for nothing.
    number = store._numbers()[-1] + 1
    (tmp_path / "atomic" / "manifests" / f"{number:012d}").write_text('{"edges": {"sour')
    assert seen() == ["old"] * 3
    with store.transaction():
        for t in tables:
            store.put(t, "source1", rows("new"))
    assert seen() == ["new"] * 3
    # A retried batch replaces its own rows.
    for _ in range(2):
        store.append("edges", rows("more"), "b1")
    assert store.read("edges").count() == 2
    # Of two writers that began with the same state the second fails.
    other = state.StateStore(spark, root)
    with pytest.raises(state.ConflictError), store.transaction():
        store.put("edges", "source1", rows("mine"))
        other.put("edges", "source1", rows("theirs"))
    assert {r["v"] for r in other.read("edges").collect()} == {"theirs", "more"}
    for _ in range(4):
        other.put("clusters", "source1", rows("last"))
    folders = {p.parent.name for p in (tmp_path / "atomic" / "clusters" / "source1").glob("*/_SUCCESS")}
    assert len(folders) <= 2 and other.read("clusters").first()["v"] == "last"


def test_lost_source_leaves_the_state(spark, tmp_path, monkeypatch):
    store = state.StateStore(spark, str(tmp_path / "lost"))
    types = spark.createDataFrame([(1, "TEXT"), (2, "REAL")], "att_id long, type string")
    features = spark.createDataFrame([("c", 1, None, None, 0.1, 0.1), ("c", 1, 0.0, 0.5, 0.1, 0.9), ("c", 1, 0.5, 1.1, 0.9, 0.001)], "cat string, att_id long, t1 double, t2 double, f_m double, f_u double")
    limits = spark.createDataFrame([("c", 1, 0.1)], "cat string, att_id long, threshold double")
    prior = spark.createDataFrame([("c", 0.5)], "cat string, dup_prob double")
    entities = spark.createDataFrame([(i, 1 if i < 6 else 2) for i in range(12)], "entity_id long, source_id long")
    cells = lambda low: spark.createDataFrame([("c", low + i, 1, f"alpha{i // 2} beta{i // 2}") for i in range(6)], "cat string, entity_id long, att_id long, value string")
    add = lambda n: incremental.add_source(store, cells(6 * (n - 1)), features, limits, prior, types, entities, n, words)
    first = {tuple(r) for r in add(1).collect()}
    put, done = state.StateStore.put, []

    def lost(self, name, part, rows):
        if name == "inserted_vectors":
            raise OSError("executor lost")
        done.append(name)
        put(self, name, part, rows)

    monkeypatch.setattr(state.StateStore, "put", lost)
    with pytest.raises(OSError, match="lost"):
        add(2)
    monkeypatch.setattr(state.StateStore, "put", put)
    assert "edges" in done and store.parts("edges") == store.parts("token_counts") == ["source1"]
    assert {tuple(r) for r in store.read("clusters").collect()} == first
    assert len({c for _, c in add(2).collect()}) == 3


def test_differences_of_global_counts_equal_a_rebuild(spark):
    from tessella.operators import deltas

    rng = random.Random(6)
    local = [(f, g, rng.randint(1, 9)) for f in range(12) for g in rng.sample("abcdefgh", 4)]
    again = [(f, g, c if rng.random() < 0.5 else rng.randint(1, 9)) for f, g, c in local if f != 3 or g < "d"] + [(3, "z", 2)]
    frame = lambda rows: spark.createDataFrame(rows, "field_id long, gram string, c long").checkpoint()
    known = lambda rows: spark.createDataFrame(rows, "local_id long, global_id long, affinity double").checkpoint()
    affinities = [[(f, rng.randint(1, 4), round(rng.random(), 3)) for f in range(12)] for _ in range(3)]
    own = spark.createDataFrame([(1, "a", 2), (5, "y", 1)], "global_id long, gram string, c long")
    states, first, second = [known(a) for a in affinities], frame(local), frame(again)
    counts = deltas.GlobalCounts.build(first, own, states[0])
    counts = counts.update(deltas.of_mappings(first, states[0], states[1]))
    counts = counts.update(deltas.of_source(first, second, states[1]))
    delta = deltas.of_mappings(second, states[1], states[2]).checkpoint()
    changed = {a for a, b in zip(affinities[1], affinities[2], strict=True) if a != b} | {b for a, b in zip(affinities[1], affinities[2], strict=True) if a != b}
    assert {r["global_id"] for r in delta.collect()} <= {a[1] for a in changed}
    counts = counts.update(delta)
    fresh = deltas.GlobalCounts.build(second, own, states[2])
    rows = lambda df: {tuple(r) for r in df.select(sorted(df.columns)).collect()}
    assert rows(counts.counts) == rows(fresh.counts) and rows(counts.df) == rows(fresh.df) and rows(counts.totals) == rows(fresh.totals)
    squares = [{r["global_id"]: r["squares"] for r in c.squares.collect()} for c in (counts, fresh)]
    assert all(abs(squares[0].get(k, 0) - v) < 1e-6 for k, v in squares[1].items())
    # Back to the first mappings: everything cancels.
    back = counts.update(deltas.of_mappings(second, states[2], states[1])).update(deltas.of_source(second, first, states[1])).update(deltas.of_mappings(first, states[1], states[0]))
    assert rows(back.counts) == rows(deltas.GlobalCounts.build(first, own, states[0]).counts)


def test_entities_without_keys_are_stable(spark):
    rows = [("a", 1), ("a", 1), ("a", None), (None, 2), (None, None), ("a", 1), ('q"', 3)]
    frame = spark.createDataFrame(rows, "x string, y int")
    first = {tuple(r) for r in ingest.wide_cells(frame, "w", ["x", "y"]).collect()}
    again = {tuple(r) for r in ingest.wide_cells(spark.createDataFrame(rows[::-1], "x string, y int").repartition(5), "w", ["x", "y"]).collect()}
    assert first == again and len({c[2] for c in first}) == 6 and len(first) == 10
    assert ingest.wide_cells(frame.limit(0), "w", ["x", "y"]).isEmpty()


def test_import_random_dictionary_and_catalogue(spark):
    data = spark.createDataFrame([(s, e, "n", f"v{e}") for s in range(6) for e in range(3)], "source_id long, entity_id long, name string, value string")
    staged = data.groupBy("source_id").agg(F.count("*").alias("n_values"))
    got = ingest.import_random(data, staged, 2, data.where("source_id = 0"))
    assert got.sources.count() == 2 and got.cells.count() == 6 and "0" not in {r["local_id"] for r in got.sources.collect()}
    attributes = spark.createDataFrame([(1, "Color"), (2, "Size")], "global_id long, name string")
    assert {tuple(r) for r in ingest.dictionary(data, "value", attributes, "COLOR").distinct().collect()} == {(1, f"v{e}") for e in range(3)}
    data.createOrReplaceTempView("staged_values")
    assert "staged_values" in ingest.tables(spark, "default") and ingest.table_attributes(spark, "staged_values") == ["source_id", "entity_id", "name", "value"]
    keys = spark.createDataFrame([(1, 9)], "global_id long, new_id long")
    assert {tuple(r) for r in state.rekey(spark.createDataFrame([(5, 1), (6, 2)], "local_id long, global_id long"), keys).collect()} == {(5, 9), (6, 2)}
