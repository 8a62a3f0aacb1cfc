"""Learning the match model: random pairs, binned similarities, thresholds, priors; from labels or a known clustering.

pairs are (cat, e1, e2) and similarities (cat, e1, e2, att_id, sim). All statistics are grouped by (cat, att_id), never
looped over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import settle
from ..functions.aggregates import first_by_hash
from . import grid, scoring

FLOOR, MARGIN = 1e-9, 1e-4
#: Entities whose pairs are looked at in the first go, and in any later one.
BATCH, BATCH_MOST = 1024, 65536
BINS, DISTANCE, RELATIVE, ABSOLUTE, STEPS = 4, 0.05, 500.0, 0.2, 200
KEY = ["cat", "att_id"]


def random_pairs(entities: DataFrame, n: int, seed: str = "pairs") -> DataFrame:
    """(cat, e1, e2), e1 < e2: two orders by hash of each category's entities, aligned by place; at most n places of each."""
    def order(side: str) -> DataFrame:
        return first_by_hash(entities.select("cat", "entity_id"), ["cat"], n, F.md5(F.concat(F.lit(f"{seed}{side}"), F.col("entity_id").cast("string"))), F.col("entity_id"))

    both = order("1").select("cat", "place", F.col("entity_id").alias("a")).join(order("2").select("cat", "place", F.col("entity_id").alias("b")), ["cat", "place"])
    return both.where("a <> b").select("cat", F.least("a", "b").alias("e1"), F.greatest("a", "b").alias("e2")).distinct()


def duplicate_pairs(known: DataFrame) -> DataFrame:
    """(cat, e1, e2), e1 < e2, of entities (cat, entity_id, global_id) with the same global id and category."""
    a = known.select("cat", "global_id", F.col("entity_id").alias("e1"))
    b = known.select("cat", "global_id", F.col("entity_id").alias("e2"))
    return a.join(b, ["cat", "global_id"]).where("e1 < e2").select("cat", "e1", "e2").distinct()


def initial_thresholds(random_sims: DataFrame, dup_prob: float, pairs: int) -> DataFrame:
    """(cat, att_id, threshold): a little below the (pairs * dup_prob + 1)-th largest similarity of random pairs."""
    k = int(pairs * dup_prob) + 1
    place = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("sim"), "e1", "e2"))
    return random_sims.withColumn("_place", place).where(F.col("_place") == k).select("cat", "att_id", (F.col("sim") - MARGIN).alias("threshold"))


def initial_features(thresholds: DataFrame, random_sims: DataFrame, types: DataFrame) -> DataFrame:
    """(cat, att_id, t1, t2, f_m, f_u): two bins, above and below the threshold."""
    low = random_sims.groupBy(KEY).agg(F.min("sim").alias("low"))
    rows = thresholds.join(low, KEY).join(F.broadcast(types), "att_id").withColumn("top", _top())
    bins = F.array(F.struct(F.col("threshold").alias("t1"), F.col("top").alias("t2"), F.lit(0.9).alias("f_m"), F.lit(0.1).alias("f_u")), F.struct(F.least("low", "threshold").alias("t1"), F.col("threshold").alias("t2"), F.lit(0.1).alias("f_m"), F.lit(0.9).alias("f_u")))
    return rows.select("cat", "att_id", F.inline(bins))


def _top() -> Column:
    """What no similarity of the attribute's type reaches."""
    return F.when(F.col("type") == "REAL", F.lit(1e-9)).otherwise(F.lit(1 + 1e-9))


def missing_rates(pairs: DataFrame, sims: DataFrame, attributes: DataFrame) -> DataFrame:
    """(cat, att_id, label, missing): share of labelled pairs (cat, e1, e2, label) without a similarity in the attribute."""
    totals = pairs.groupBy("cat", "label").agg(F.count("*").alias("n"))
    have = sims.join(pairs, ["cat", "e1", "e2"]).groupBy("cat", "att_id", "label").agg(F.count("*").alias("have"))
    grid = totals.crossJoin(F.broadcast(attributes.select("att_id").distinct()))
    return grid.join(have, ["cat", "att_id", "label"], "left").select("cat", "att_id", "label", (1 - F.try_divide(F.coalesce("have", F.lit(0)), "n")).alias("missing"))


def bin_edges(sims: DataFrame, types: DataFrame, bins: int = BINS) -> DataFrame:
    """(cat, att_id, bin, t1, t2): bins of equal width from the smallest similarity to the type's top."""
    low = sims.groupBy(KEY).agg(F.min("sim").alias("low")).join(F.broadcast(types), "att_id").withColumn("width", (_top() - F.col("low")) / bins)
    return low.where("width > 0").select("cat", "att_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "low", "width").select("cat", "att_id", "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("t1"), (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("t2"))


def bin_probabilities(edges: DataFrame, labelled: DataFrame) -> DataFrame:
    """edges with f_m and f_u: shares of the Yes and of the No pairs of labelled (cat, att_id, sim, label) in each bin.

    Bins are equally wide, so a similarity's bin is computed, not searched.
    """
    width = edges.where("bin = 0").select("cat", "att_id", F.col("t1").alias("low"), (F.col("t2") - F.col("t1")).alias("width"))
    bins = edges.groupBy(KEY).agg((F.max("bin") + 1).alias("bins"))
    at = F.greatest(F.lit(0), F.least(F.floor((F.col("sim") - F.col("low")) / F.col("width")), F.col("bins") - 1)).cast("int")
    rows = labelled.join(F.broadcast(width), KEY).join(F.broadcast(bins), KEY).withColumn("bin", at)
    counts = rows.groupBy(*KEY, "bin").agg(F.count_if(F.col("label") == "Yes").alias("yes"), F.count_if(F.col("label") == "No").alias("no"))
    whole = Window.partitionBy(KEY)
    full = edges.join(counts, [*KEY, "bin"], "left").fillna(0, ["yes", "no"])
    return full.select("cat", "att_id", "bin", "t1", "t2", F.try_divide("yes", F.sum("yes").over(whole)).alias("f_m"), F.try_divide("no", F.sum("no").over(whole)).alias("f_u"))


def guarded_corr(x: Column, y: Column) -> Column:
    """Correlation, null where either side is constant."""
    return F.when((F.var_pop(x) > 1e-15) & (F.var_pop(y) > 1e-15), F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))))


def useful_attributes(features: DataFrame, distance: float = DISTANCE) -> DataFrame:
    """(cat, att_id, diff, corr_m, corr_u) of attributes whose bins tell matches apart: total difference large enough, P(bin|match) rising, P(bin|non-match) falling."""
    middle = F.col("t1") + F.col("t2")
    stats = features.groupBy(KEY).agg(F.sum(F.abs(F.col("f_m") - F.col("f_u"))).alias("diff"), guarded_corr(F.col("f_m"), middle).alias("corr_m"), guarded_corr(F.col("f_u"), middle).alias("corr_u"))
    return stats.where(F.col("diff") >= distance).where("corr_m > 0 and corr_u < 0")


def floored(features: DataFrame) -> DataFrame:
    """Zero probabilities replaced by a tiny one."""
    return features.withColumns({c: F.greatest(F.col(c), F.lit(FLOOR)) for c in ("f_m", "f_u")})


def learned_thresholds(features: DataFrame, relative: float = RELATIVE, absolute: float = ABSOLUTE, steps: int = STEPS) -> DataFrame:
    """(cat, att_id, threshold): the first of evenly spaced similarities at which enough matches and few enough non-matches lie above.

    Within a bin probabilities are interpolated. Attributes where no step will do get their lowest edge.
    """
    before = Window.partitionBy(KEY).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cum = features.withColumns({"cum_m": F.coalesce(F.sum("f_m").over(before), F.lit(0.0)), "cum_u": F.coalesce(F.sum("f_u").over(before), F.lit(0.0))})
    part = F.col("step") / float(steps)
    rows = cum.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")).withColumns({"m": 1 - (F.col("cum_m") + part * F.col("f_m")), "u": 1 - (F.col("cum_u") + part * F.col("f_u")), "t": F.col("t1") + part * (F.col("t2") - F.col("t1"))})
    good = (F.round("m", 9) > absolute) & (F.round("m", 9) > relative * F.greatest(F.round("u", 9), F.lit(FLOOR)))
    return rows.groupBy(KEY).agg(F.coalesce(F.min(F.when(good, F.col("t"))), F.min("t1")).alias("threshold"))


def prior_from_labels(features: DataFrame, random_sims: DataFrame, labelled: DataFrame) -> DataFrame:
    """(cat, dup_prob): the largest over attributes of the sum over bins of P(bin | random) * P(Yes | bin)."""
    edges = features.select("cat", "att_id", "bin", "t1", "t2")
    inside = "s.cat = b.cat and s.att_id = b.att_id and s.sim >= b.t1 and s.sim < b.t2"
    rnd = random_sims.alias("s").join(F.broadcast(edges).alias("b"), F.expr(inside)).groupBy("b.cat", "b.att_id", "b.bin").agg(F.count("*").alias("n"))
    rnd = rnd.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(KEY)))
    yes = labelled.alias("s").join(F.broadcast(edges).alias("b"), F.expr(inside)).groupBy("b.cat", "b.att_id", "b.bin").agg(F.avg((F.col("s.label") == "Yes").cast("double")).alias("yes"))
    return rnd.join(yes, [*KEY, "bin"]).groupBy(KEY).agg(F.sum(F.col("p") * F.col("yes")).alias("dup")).groupBy("cat").agg(F.max("dup").alias("dup_prob"))


def prior_from_clustering(entities: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(cat, dup_prob): 100 times the share of duplicate pairs among all pairs, at least 1e-5 and below 1."""
    n = entities.groupBy("cat").agg(F.count("*").alias("n"))
    d = duplicates.groupBy("cat").agg(F.count("*").alias("dups"))
    share = F.try_divide(100.0 * F.coalesce("dups", F.lit(0)), F.col("n") * (F.col("n") - 1) / 2)
    return n.join(d, "cat", "left").select("cat", F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-5), F.coalesce(share, F.lit(0.0)))).alias("dup_prob"))


def non_match_probability(f: Column, f_m: Column, dup: Column) -> Column:
    """P(f | non-match) of P(f), P(f | match) and the prior, within FLOOR and 1."""
    return F.greatest(F.lit(FLOOR), F.least(F.lit(1.0), (f - f_m * dup) / (1 - dup)))


def _model(sims: DataFrame, labelled: DataFrame, pairs: DataFrame, types: DataFrame, bins: int) -> tuple[DataFrame, DataFrame]:
    binned = floored(bin_probabilities(bin_edges(sims, types, bins), labelled))
    kept = useful_attributes(binned).select(KEY)
    nulls = missing_rates(pairs, labelled.select("cat", "e1", "e2", "att_id"), types).groupBy(KEY).agg(F.max(F.when(F.col("label") == "Yes", F.col("missing"))).alias("f_m"), F.max(F.when(F.col("label") == "No", F.col("missing"))).alias("f_u"))
    nulls = floored(nulls.join(kept, KEY, "left_semi")).select("cat", "att_id", F.lit(None).cast("double").alias("t1"), F.lit(None).cast("double").alias("t2"), "f_m", "f_u")
    return binned.join(kept, KEY, "left_semi"), nulls


def learn_from_labels(labels: DataFrame, sims: DataFrame, random_sims: DataFrame, types: DataFrame, bins: int = BINS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, thresholds, dup_prob) from labels (cat, e1, e2, label), Yes or No in any case, and the pairs' similarities."""
    pairs = labels.select("cat", "e1", "e2", F.initcap("label").alias("label")).where("label in ('Yes', 'No')")
    labelled = sims.join(pairs, ["cat", "e1", "e2"])
    binned, nulls = _model(random_sims, labelled, pairs, types, bins)
    features = binned.select("cat", "att_id", "t1", "t2", "f_m", "f_u").unionByName(nulls)
    return features, learned_thresholds(binned), prior_from_labels(binned, random_sims, labelled)


def learn_from_clustering(known: DataFrame, sims: DataFrame, random_sims: DataFrame, types: DataFrame, bins: int = BINS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, thresholds, dup_prob) from entities with a global id; sims of duplicates, random_sims of random pairs.

    P(bin | non-match) follows from the random pairs' P(bin) and the prior.
    """
    dups = duplicate_pairs(known)
    prior = prior_from_clustering(known, dups)
    pairs = dups.withColumn("label", F.lit("Yes")).unionByName(random_sims.select("cat", "e1", "e2").distinct().withColumn("label", F.lit("No")))
    labelled = sims.withColumn("label", F.lit("Yes")).unionByName(random_sims.withColumn("label", F.lit("No")))
    binned, nulls = _model(random_sims.unionByName(sims), labelled, pairs, types, bins)

    def corrected(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(prior), "cat").withColumn("f_u", non_match_probability(F.col("f_u"), F.col("f_m"), F.col("dup_prob"))).drop("dup_prob")

    binned = corrected(binned)
    return binned.select("cat", "att_id", "t1", "t2", "f_m", "f_u").unionByName(corrected(nulls)), learned_thresholds(binned), prior


def pair_similarities(pairs: DataFrame, vecs: DataFrame, nums: DataFrame) -> DataFrame:
    """(cat, e1, e2, att_id, sim) of pairs by packed token vectors and numbers, 0 where both have the attribute and share nothing.

    Pairs are few beside entities: what the latter have is cut down to the pairs' own, whose files' size tells Spark so, before any shuffle.
    """
    pairs = settle(pairs)
    ends = pairs.select("cat", F.explode(F.array("e1", "e2")).alias("entity_id"))
    own = lambda rows: rows.join(ends, ["cat", "entity_id"], "left_semi").select(rows.columns)
    return scoring.similarities(pairs, own(vecs), own(nums))


def populate_questions(entities: DataFrame, vecs: DataFrame, nums: DataFrame, types: DataFrame, facts: Callable[[DataFrame], DataFrame], dup_prob: float, sample: int, budget: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, thresholds, questions) without any label yet.

    Similarities of random pairs of entities (cat, entity_id) give each attribute a first threshold and two bins; facts(thresholds) are
    those of ``grid``, which say what pairs are candidates, and the least certain of them by that model are the questions.
    """
    sims = settle(pair_similarities(random_pairs(entities, sample), vecs, nums))
    thresholds = settle(initial_thresholds(sims, dup_prob, sample))
    features = initial_features(thresholds, sims, types)
    features = settle(features.unionByName(features.select(*KEY).distinct().select(*KEY, F.lit(None).cast("double").alias("t1"), F.lit(None).cast("double").alias("t2"), F.lit(0.5).alias("f_m"), F.lit(0.5).alias("f_u"))))
    prior = entities.select("cat").distinct().withColumn("dup_prob", F.lit(dup_prob))
    return features, thresholds, least_certain(facts(thresholds), entities, features, prior, budget)


def least_certain(facts: DataFrame, entities: DataFrame, features: DataFrame, prior: DataFrame, budget: int = 50, batch: int = BATCH) -> DataFrame:
    """question_pairs of all candidates of facts, without a list of them; facts are of entities (cat, entity_id), an attribute is text or numbers.

    A pair's probability is one of few, so that it is known how near 0.5 any pair may come. Entities are first ones of a pair in the order of
    questions, some at a time, each against all after them: once budget pairs are as near as any may come, those that follow come later. If
    too few are, all entities have their turn, and all candidates are scored.
    """
    spark = facts.sparkSession
    if not entities.groupBy("entity_id").agg(F.count_distinct("cat").alias("n")).where("n > 1").isEmpty():
        return question_pairs(grid.scored_pairs(facts, features, prior), entities, budget)
    model, order = grid.Model(features, prior), F.struct("cat", "entity_id")
    nearest = {c: abs(model.values(c) - 0.5).min(initial=1.0) for c in model.prior if c is not None}
    whole = facts.where(F.col("cat").isNotNull())
    firsts = whole.where("heads is not null or numbers is not null").select("cat", "entity_id").distinct()
    block = int(min(grid.BLOCK, max(BATCH, firsts.count() // (2 * spark.sparkContext.defaultParallelism))))
    found: list[tuple] = []
    after = after_cat = None
    while budget > 0:
        rest, firsts_ = (x if after is None else x.where(order > after) for x in (whole, firsts))
        last = firsts_.orderBy("cat", "entity_id").limit(batch).agg(F.max(order).alias("last")).first()["last"]
        if last is None or (len(found) == budget and found[-1][0] <= min((v for c, v in nearest.items() if c >= after_cat), default=1.0)):
            break
        end, after_cat = F.struct(F.lit(last["cat"]).alias("cat"), F.lit(last["entity_id"]).cast("long").alias("entity_id")), last["cat"]
        scored = grid.category_scores(rest.where(order <= end), model, rest, block=block, least=1).where("e1 < e2")
        scored = scored.select(F.abs(F.col("probability") - 0.5).alias("apart"), "cat", "e1", "e2", "probability").orderBy("apart", "cat", "e1", "e2").limit(budget)
        found = sorted([*found, *map(tuple, scored.collect())])[:budget]
        after, batch = end, min(2 * batch, BATCH_MOST)
    return spark.createDataFrame([(*r[1:], None) for r in found], "cat string, e1 long, e2 long, sim double, human_label string")


def question_pairs(scored: DataFrame, categories: DataFrame, budget: int = 50) -> DataFrame:
    """(cat, e1, e2, sim, human_label): scored pairs (e1, e2, probability) within a category, the least certain first."""
    a = categories.select(F.col("entity_id").alias("e1"), "cat")
    b = categories.select(F.col("entity_id").alias("e2"), "cat")
    return scored.join(a, "e1").join(b, ["e2", "cat"]).orderBy(F.abs(F.col("probability") - 0.5), "cat", "e1", "e2").limit(budget).select("cat", "e1", "e2", F.col("probability").alias("sim"), F.lit(None).cast("string").alias("human_label"))
