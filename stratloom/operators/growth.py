"""Trees grown level by level, all trees of all jobs at once, as aggregates over binned features.

Features are binned once, by the ranks of their distinct values over all samples.  Then a level of all
trees is one aggregation: weights and sums of y by (job, tree, node, feature, bin), with partial
sums before the exchange, whose size follows nodes and bins and not samples.  Cumulated over a
node's bins they give the decrease of squares of every split; the best one of a node is a
``max_by``.  Members move to their child by their own bin and the next level follows.

A job is one training set under one configuration; folds, configurations and bootstrap trees grow side by side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .lineage import settle
from .ranks import met, running

BINS = 32
DIGITS = 6  # gains equal to so many digits are ties, which the lower feature and bin win
NODES = "job long, tree int, node long, n double, value double, feature int, bin int, cut double, gain double"


def binned(samples: DataFrame, bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """samples (sample, x, ...) with ``bins``, an array of the bin of each feature of the array x, and the bins as
    (feature, bin, lo, hi), by value.  A feature with at most ``bins`` distinct values has one for each, so that
    every midpoint is a candidate; others have ``bins`` with as many distinct values each.  A null is in bin -1, below all others."""
    long = samples.select(F.posexplode(F.col("x").cast("array<double>")).alias("feature", "v"))
    values = long.filter("v is not null").distinct().withColumn("n", F.lit(1).cast("long"))
    ranked = running(values, ["feature"], "v", ["n"])
    code = F.when(F.col("all_n") <= bins, F.col("before_n")).otherwise(F.expr(f"before_n * {bins} div all_n")).cast("int")
    ends = settle(ranked.select("feature", "v", code.alias("bin")).groupBy("feature", "bin").agg(F.min("v").alias("lo"), F.max("v").alias("hi")))  # features by bins rows
    # a value's bin is how many bins begin at or below it, less one: no join with the distinct values
    starts = ends.groupBy("feature").agg(F.array_sort(F.collect_list("lo")).alias("s")).agg(F.map_from_entries(F.collect_list(F.struct("feature", "s"))).alias("starts"))
    below = lambda v, n: F.size(F.filter(F.col("starts")[n], lambda lo: lo <= v)) - 1
    coded = F.transform(F.col("x").cast("array<double>"), lambda v, n: F.when(v.isNull(), -1).otherwise(below(v, n)).cast("int"))
    return samples.join(F.broadcast(starts), F.lit(True), "left").withColumn("bins", coded).drop("starts", "x"), ends  # one row of features by bins values


def splits(members: DataFrame, jobs: DataFrame, ends: DataFrame, seed: int = 0, min_gain: float = 1e-6) -> DataFrame:
    """The nodes of a level as NODES rows, with the best split of each (null where there is none) from members
    (job, tree, node, w, y, bins) and jobs (job, least, mtry).

    mtry features of a node, drawn by a hash of seed, job, tree, node and feature, are looked at; null is all of them."""
    at = ["job", "tree", "node"]
    nodes = members.groupBy(*at).agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("value"), F.max(F.size("bins")).alias("width")).join(F.broadcast(jobs), "job")
    drawn = F.array_sort(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda f: F.struct(F.xxhash64(F.lit(seed), "job", "tree", "node", f).alias("h"), f.alias("f"))))
    take = F.when(F.col("mtry").isNull(), F.sequence(F.lit(0), F.col("width") - 1)).otherwise(F.transform(F.slice(drawn, F.lit(1), F.greatest(F.lit(1), F.col("mtry"))), lambda d: d["f"]))
    seen = members.join(nodes.filter(F.col("n") >= 2 * F.col("least")).select(*at, take.alias("take")), at)
    # a member's bins are picked in place, so that the rows of its features don't each carry all of them
    pick = seen.select(*at, "w", "y", F.explode(F.transform("take", lambda f: F.struct(f.alias("feature"), F.col("bins")[f].alias("bin")))).alias("x"))
    hist = pick.select(*at, "w", "y", "x.feature", "x.bin").groupBy(*at, "feature", "bin").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s"))
    up = W.partitionBy(*at, "feature").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)  # a row for each bin
    all_ = W.partitionBy(*at, "feature")
    cum = hist.withColumns({"lw": F.sum("w").over(up), "ls": F.sum("s").over(up), "tw": F.sum("w").over(all_), "ts": F.sum("s").over(all_)})
    rw, rs = F.col("tw") - F.col("lw"), F.col("ts") - F.col("ls")
    gain = F.round(F.col("ls") ** 2 / F.col("lw") + rs**2 / rw - F.col("ts") ** 2 / F.col("tw"), DIGITS)
    cand = cum.join(F.broadcast(jobs.select("job", "least")), "job").filter((F.col("lw") >= F.col("least")) & (rw >= F.col("least")) & (rw > 0)).withColumn("gain", gain).filter(F.col("gain") >= min_gain)
    best = cand.groupBy(*at).agg(F.max_by(F.struct("feature", "bin", "gain"), F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("b")).select(*at, "b.*")
    # the cut lies halfway to the next bin of the feature
    step = ends.select("feature", "bin", "hi", F.lead("lo").over(W.partitionBy("feature").orderBy("bin")).alias("next"))
    least_lo = ends.filter("bin = 0").select("feature", F.lit(-1).alias("bin"), F.lit(None).cast("double").alias("hi"), F.col("lo").alias("next"))
    cuts = step.unionByName(least_lo).select("feature", "bin", F.coalesce((F.col("hi") + F.col("next")) / 2, "next").alias("cut"))
    best = best.join(F.broadcast(cuts), ["feature", "bin"], "left")
    return nodes.select(*at, F.col("n").cast("double").alias("n"), "value").join(best, at, "left").select(*at, "n", "value", "feature", "bin", "cut", "gain")


def grow(members: DataFrame, jobs: DataFrame, ends: DataFrame, seed: int = 0) -> DataFrame:
    """All nodes of all trees, NODES rows, from members (job, tree, w, y, bins) and jobs (job, depth, least,
    mtry).  The root is node 0, the children of n are 2n + 1 (bins up to the split's) and 2n + 2.

    A level is written before the next, so its cost is that of its members, of which those in leaves are left out."""
    deepest = jobs.agg(F.max("depth")).first()[0] or 0
    held = settle(members.withColumn("node", F.lit(0).cast("long")).select("job", "tree", "node", "w", "y", "bins"))
    out = None
    for level in range(deepest + 1):
        deep = jobs.filter(F.col("depth") > level).select("job", "least", "mtry")
        inner = settle(splits(held.join(F.broadcast(deep.select("job")), "job", "left_semi"), deep, ends, seed))
        ended = held.join(F.broadcast(deep.select("job")), "job", "left_anti").groupBy("job", "tree", "node").agg(F.sum("w").cast("double").alias("n"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("value"))
        ended = ended.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("feature", "int"), ("bin", "int"), ("cut", "double"), ("gain", "double"))))
        level_nodes = inner.unionByName(ended)
        out = level_nodes if out is None else out.unionByName(level_nodes)
        split = inner.filter("feature is not null").select("job", "tree", "node", "feature", "bin")
        if level == deepest or split.isEmpty():
            return out
        right = F.when(F.col("bins")[F.col("feature")] > F.col("bin"), 2).otherwise(1)
        held = settle(held.join(split, ["job", "tree", "node"]).select("job", "tree", (2 * F.col("node") + right).alias("node"), "w", "y", "bins"))
    return out


def predict(rows: DataFrame, nodes: DataFrame, depths: Sequence[int] = (62,)) -> DataFrame:
    """(job, tree, sample, depth, value) of rows (job, sample, bins) by the trees of their job, each cut off at
    every one of ``depths``: a tree of depth 4 is the upper part of one of depth 8 that was grown alike.

    A tree is a map in one row; a row of samples walks it by an expression as long as the trees are deep."""
    trees = nodes.groupBy("job", "tree").agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("feature", "bin", "value")))).alias("t"))
    deepest = int(nodes.agg(F.max(F.floor(F.log2(F.col("node") + 1.0)))).first()[0] or 0)
    out = met(rows, trees, ["job"]).withColumn("_0", F.lit(0).cast("long"))
    for level in range(deepest):
        here = F.col("t")[F.col(f"_{level}")]
        down = 2 * F.col(f"_{level}") + F.when(F.col("bins")[here["feature"]] > here["bin"], 2).otherwise(1)
        out = out.withColumn(f"_{level + 1}", F.when(here["feature"].isNull(), F.col(f"_{level}")).otherwise(down))
    ends = F.array(*(F.struct(F.lit(d).alias("depth"), F.col("t")[F.col(f"_{min(d, deepest)}")]["value"].alias("value")) for d in depths))
    return out.select("job", "tree", "sample", F.explode(ends).alias("e")).select("job", "tree", "sample", "e.depth", "e.value")


def bootstrap(samples: DataFrame, trees: int, seed: int = 0, share: float = 1.0) -> DataFrame:
    """samples (job, sample, ...) once for each tree that draws them, with ``tree`` and the times ``w``: a Poisson
    count of mean ``share`` by a hash of seed, job, tree and sample.  What a tree doesn't draw is out of its bag."""
    u = F.pmod(F.xxhash64(F.lit(seed), "job", "tree", "sample"), F.lit(1 << 52)) / float(1 << 52)
    # the distribution of the count: shares of at most 0, 1, ... draws
    total, term, shares = 0.0, math.exp(-share), []
    for k in range(16):
        total += term
        shares.append(total)
        term *= share / (k + 1)
    w = F.size(F.filter(F.array(*map(F.lit, shares)), lambda s: s <= u))
    return samples.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("w", w.cast("long")).filter("w > 0")
