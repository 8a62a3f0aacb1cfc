"""Mixing sources to target weights by pivotal dependent rounding.

Targets: sources in code-point order, null last, weigh WEIGHTS in turn and share BUDGET times all words; no target is
above MOST times its source's words, and what is above is shared again by weight until none is (water filling, solved in
closed form over one row for each source). A document of a source of rate r = target / words is taken floor(r) times
and once more with probability r - floor(r).

Which documents get the extra copy is decided by pivotal rounding: of two documents with fractional probabilities, mass
goes from one to the other so that the expected words stay, until one of them is 0 or 1. Blocks of documents, dealt by
hash, are rounded in parallel and leave one fractional document each; these go up a tree, FAN to a node, until one is left
for each source, which is drawn. Large documents come first, so that the one left is small
and the words taken of a source miss its target by less than that. Draws are hashes of a seed, all columns of the row, and
its number among equal rows (which of them gets which number makes no difference), so that reruns agree however the rows
are ordered, split or partitioned.

Edge cases: null and empty texts have size 0 and are never taken in words; a source whose documents are all empty has
target 0; repeated rows are separate documents; null doc_ids are allowed; an empty table gives no rows; ``mix`` keeps
all columns, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settle

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, MOST = 1.5, 2.0
BLOCK, FAN, SEED = 4096, 256, 17
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of rows (source, size); one row for each source is windowed, not the documents."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = totals.withColumn("weight", weights).withColumn("cap", MOST * F.col("source_size")).withColumn("turn", F.col("cap") / F.col("weight"))
    # With level L a source gets min(cap, weight * L). Sources reach their caps in order of turn; L is the first level at
    # which the sources still open take up what the closed ones leave.
    order = Window.orderBy("turn", F.col("source").asc_nulls_last())
    rows = rows.withColumn("closed", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    rows = rows.withColumn("level", (BUDGET * F.col("all") - F.col("closed")) / F.col("open"))
    first = F.min(F.when(F.col("level") <= F.col("turn"), F.struct("turn", "level"))).over(Window.partitionBy())
    rows = rows.withColumn("first", first)
    level = F.col("first.level")
    target = F.least("cap", F.col("weight") * F.coalesce(level, F.lit(float("inf"))))
    return rows.select("source", "source_size", target.alias("target"))


def round_block(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounded probabilities and the position of the one that stays fractional, -1 if none."""
    p, at = p.astype(float).copy(), -1
    for i in range(len(p)):
        if not 1e-12 < p[i] < 1 - 1e-12:
            p[i] = round(p[i])
            continue
        if at < 0:
            at = i
            continue
        a, b = float(size[at]), float(size[i])
        up = min((1 - p[at]) * a, p[i] * b)
        down = min(p[at] * a, (1 - p[i]) * b)
        gain = up if draw[i] * (up + down) < down else -down
        p[at] += gain / a
        p[i] -= gain / b
        for j in (at, i):
            if p[j] < 1e-9 or p[j] > 1 - 1e-9:
                p[j] = round(p[j])
        if p[at] in (0.0, 1.0):
            at = i if 0 < p[i] < 1 else -1
    return p, at


def _round(last: bool):
    def run(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "draw", "row"], ascending=[False, True, True], ignore_index=True)
        p, at = round_block(rows["size"].to_numpy(), rows["p"].to_numpy(), rows["draw"].to_numpy())
        if last and at >= 0:
            p[at] = 1.0 if rows["draw"][at] < p[at] else 0.0
        return rows.assign(p=p)[["source", "row", "size", "draw", "p", "block"]]

    return run


def _content(docs: DataFrame, seed: int):
    """A hash of all columns of a row, nulls told apart."""
    cols = [F.to_json(F.struct(docs[f.name])) if "map<" in f.dataType.simpleString() else docs[f.name] for f in docs.schema.fields]
    return F.xxhash64(F.lit(seed), *cols, *[c.isNull() for c in cols])


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (row, k1, k2, ...) with their number among the rows of equal content.

    Only contents that repeat are looked at: rows are numbered within their part of the input, parts add up, so that no
    task holds all copies of a content.
    """
    keys = ["k1", "k2"]
    repeated = rows.groupBy(keys).agg(F.count("*").alias("n")).where("n > 1").select(keys)
    some = rows.select(*keys, "row", F.shiftright("row", 33).alias("part")).join(repeated, keys, "left_semi")
    counts = some.groupBy(*keys, "part").agg(F.count("*").alias("c"))
    earlier = F.sum("c").over(Window.partitionBy(keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("start", F.coalesce(earlier, F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("row")) - 1
    numbers = some.withColumn("place", place).join(starts, [*keys, "part"]).select("row", (F.col("start") + F.col("place")).alias("number"))
    return rows.join(numbers, "row", "left").withColumn("number", F.coalesce("number", F.lit(0)))


def copies(docs: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each row of docs: doc (struct of the columns to keep), size, source_size, target, copies."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size")
    content = [_content(docs, SEED + i).alias(f"k{i}") for i in (1, 2)]
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), F.col("source").cast("string").alias("source"), size, *content, F.monotonically_increasing_id().alias("row"))
    rows = settle(rows, "sized")
    goals = settle(targets(rows.select("source", "size")), "targets").withColumnRenamed("source", "of")
    joined = rows.join(goals, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.withColumn("rate", F.least(rate, F.lit(MOST))).withColumn("whole", F.floor("rate"))
    fraction = F.when(F.col("size") > 0, F.col("rate") - F.col("whole")).otherwise(0.0)
    total = max(1, math.ceil(rows.count() / BLOCK))
    numbered = _numbered(joined.select("source", "row", "size", "k1", "k2", fraction.alias("p")))
    draw = F.pmod(F.xxhash64("k1", "k2", "number", F.lit(SEED)), F.lit(1 << 52)) / float(1 << 52)
    block = F.pmod(F.xxhash64("k1", "k2", "number", F.lit(SEED + 1)), F.lit(total))
    parts = settle(numbered.select("source", "row", "size", draw.alias("draw"), "p", block.alias("block")), "parts")
    schema = "source string, row long, size long, draw double, p double, block long"
    rest, extra, level, done = parts.where("p > 1e-12 and p < 1 - 1e-12"), parts.where("p >= 1 - 1e-12").select("row"), 0, []
    while True:
        last = total == 1
        found = settle(rest.groupBy("source", "block").applyInPandas(_round(last), schema), f"rounded{level}")
        done.append(found)
        extra = extra.union(found.where("p = 1").select("row"))
        if last:
            break
        total, level = math.ceil(total / FAN), level + 1
        rest = found.where("p > 0 and p < 1").withColumn("block", F.pmod("block", F.lit(total)))
    extra = settle(extra, "extra")
    discard(parts, *done)
    # As many rows as the mix takes: never broadcast, however small its files are.
    taken = joined.join(extra.withColumn("extra", F.lit(1)).hint("merge"), "row", "left")
    return taken.select("doc", "size", "source_size", "target", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix: rows of docs, each as often as it is taken."""
    return copies(docs, docs.columns).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
