from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tessella.operators import candidates, grid, pairsim, scoring
from tessella.plans import registry


def _rows(seed: int = 3):
    rng = random.Random(seed)
    tokens = [(c, e, a, f"t{rng.randrange(9)}", rng.choice([0.0, 0.3, 0.9])) for c in "xy" for e in range(14) for a in (1, 3) for _ in range(rng.randrange(4))]
    tokens = list({t[:4]: t for t in tokens}.values())
    numbers = [(c, e, 2, float(rng.randrange(40))) for c in "xy" for e in range(14) for _ in range(rng.randrange(3))]
    return tokens, numbers


def _expected(tokens, numbers, width, pairs):
    vec, num = {}, {}
    for c, e, a, t, w in tokens:
        vec.setdefault((c, e, a), {})[t] = w
    for c, e, a, v in numbers:
        num.setdefault((c, e, a), []).append(v)
    out = {}
    for c in "xy":
        for x, y in pairs:
            sims = {}
            found = False
            for a in (1, 3):
                if (c, x, a) in vec and (c, y, a) in vec:
                    p, q = vec[c, x, a], vec[c, y, a]
                    found |= bool(p.keys() & q.keys())
                    sims[a] = sum(p[t] * q[t] for t in p.keys() & q.keys())
            if (c, x, 2) in num and (c, y, 2) in num:
                sims[2] = max(-abs(v - u) for v in num[c, x, 2] for u in num[c, y, 2])
                found |= -sims[2] <= width
            if found:
                out[c, x, y] = sims
    return out


@pytest.mark.parametrize(("block", "cells", "hits"), [(3, 5, 2), (8192, 1 << 19, 1 << 21)])
def test_grid_against_brute_force(spark, monkeypatch, block, cells, hits):
    monkeypatch.setattr(grid, "CELLS", cells)
    monkeypatch.setattr(grid, "HITS", hits)
    tokens, numbers = _rows()
    vecs = spark.createDataFrame(tokens, "cat string, entity_id long, att_id long, token string, w double")
    nums = spark.createDataFrame(numbers, "cat string, entity_id long, att_id long, v double")
    widths = spark.createDataFrame([("x", 2, -2.0), ("y", 2, -2.0)], "cat string, att_id long, threshold double")
    facts = grid.facts(vecs, scoring.packed_vectors(vecs), nums, widths).checkpoint()
    want = _expected(tokens, numbers, 2.0, [(a, b) for a in range(14) for b in range(a + 1, 14)])
    found = grid.candidate_pairs(facts, block=block).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == set(want)
    sims = {(r["cat"], r["e1"], r["e2"]): {s["att_id"]: s["sim"] for s in r["sims"]} for r in grid.candidate_facts(facts, block=block).collect()}
    assert sims.keys() == want.keys() and all(sims[k] == pytest.approx(want[k]) for k in want)
    even, odd = facts.where("entity_id % 2 = 0"), facts.where("entity_id % 2 = 1")
    two = _expected(tokens, numbers, 2.0, [(a, b) for a in range(0, 14, 2) for b in range(1, 14, 2)])
    assert sorted(map(tuple, grid.candidate_pairs(even, odd, block=block).collect())) == sorted(two)
    limits = spark.createDataFrame([(c, a, 0.3) for c in "xy" for a in (1, 3)], "cat string, att_id long, threshold double")
    plain = {tuple(r)[:4]: r["sim"] for r in candidates.cosine_pairs(vecs, vecs, limits).collect()}
    assert {tuple(r)[:4]: r["sim"] for r in grid.cosine_pairs(scoring.packed_vectors(vecs), limits, block=block).collect()} == pytest.approx(plain)
    features = spark.createDataFrame([(c, a, *r) for c in "xy" for a in (1, 2) for r in ((None, None, 0.1, 0.2), (-9.0, 0.2, 0.3, 0.7), (0.2, 2.0, 0.6, 0.1))], "cat string, att_id long, t1 double, t2 double, f_m double, f_u double")
    prior = spark.createDataFrame([("x", 0.1), ("y", 0.2)], "cat string, dup_prob double")
    old = {tuple(r)[:2]: r["probability"] for r in scoring.score_pairs(grid.candidate_pairs(facts), scoring.packed_vectors(vecs), nums, features, prior).collect()}
    assert {tuple(r)[:2]: r["probability"] for r in grid.scored_pairs(facts, features, prior, block=block).collect()} == pytest.approx(old)
    high = {tuple(r)[:2] for r in grid.scored_pairs(facts, features, prior, floor=0.2, block=block).collect()}
    assert high == {k for k, v in old.items() if v >= 0.2}


@pytest.mark.parametrize("name", ["cand_self", "cand_all", "cand_twoway", "cand_cosine", "pair_numeric_sim", "match_prob"])
def test_pairs_are_not_shuffled(spark, name):
    """Nothing is dealt anew above the task that makes the pairs."""
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMapGroupsInArrow" in plan or "FlatMapGroupsInPandas" in plan or "FlatMapGroups" in plan
    assert "Aggregate" not in plan.split("FlatMapGroups")[0]


@pytest.mark.parametrize("name", ["pairsim_cosine", "pairsim_overall", "pairsim_overall_by_size"])
def test_supplier_pairs_are_not_shuffled(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMapGroups" in plan and "Aggregate" not in plan.split("FlatMapGroups")[0]


def test_weighted_pairs_as_by_joins(spark):
    cells = spark.createDataFrame([(e, f, v) for e in range(9) for f, v in ((1, f"name {e % 4}"), (2, f"other {e}"), (3, "x")) if (e + f) % 4], "entity_id long, field_id long, value string")
    toks = pairsim.tokens(cells).checkpoint()
    weights = spark.createDataFrame([(1, 2.0), (2, 0.5), (3, None)], "field_id long, weight double")
    sims, vectors = pairsim.field_cosines(toks).checkpoint(), pairsim.packed(toks).checkpoint()
    same = lambda rows: {(r["a"], r["b"]): r["sim"] for r in rows.select("a", "b", F.round("sim", 9).alias("sim")).collect()}
    assert {tuple(r)[:3]: round(r["sim"], 9) for r in pairsim.token_cosines(vectors).collect()} == {tuple(r)[:3]: round(r["sim"], 9) for r in sims.collect()}
    assert same(pairsim.token_overall(vectors, weights)) == same(pairsim.overall(sims, weights))
    assert same(pairsim.token_overall(vectors, weights, by_size=True)) == same(pairsim.overall_by_size(sims, weights, toks))


def test_weights_of_groups_list_no_pair(spark, monkeypatch):
    cells = spark.createDataFrame([(e, f, v) for e in range(24) for f, v in ((1, f"name {e % 5}"), (2, f"{'abcdefgh'[e % 8]}{'abcdefgh'[e % 3]}x")) if (e + f) % 7], "entity_id long, field_id long, value string")
    groups = spark.createDataFrame([(e, e % 4 if e < 20 else None) for e in range(24)], "entity_id long, group_id long")
    known = groups.toDF("entity_a", "g").join(groups.toDF("entity_b", "g"), "g").where("entity_a < entity_b")
    toks = pairsim.tokens(cells).checkpoint()
    same = lambda rows: {r["field_id"]: round(r["weight"], 9) for r in rows.collect()}
    want = same(pairsim.field_weights(pairsim.field_cosines(toks), known))
    assert same(pairsim.token_field_weights(toks, known, hot=2)) == want
    monkeypatch.setattr(pairsim, "text_similarities", None)
    monkeypatch.setattr(pairsim, "_known", None)
    assert same(pairsim.group_field_weights(toks, groups, hot=2)) == want == same(pairsim.group_field_weights(toks, groups))
    assert len(want) == 2
