"""Accuracy, agreement, distribution and ranking measures as aggregate expressions.

All are algebraic aggregates over (y_true, y_pred), so Spark combines them before the
exchange; what needs an order takes its ranks from ``ranks`` and its quantiles from
``quantiles``, which spread a group over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, erfc
from .quantiles import quantiles
from .ranks import average_rank, met, row_numbers, running

TINY = 1e-300


def accuracy(y: Column, p: Column) -> dict[str, Column]:
    """R2 (1 - SSR / SST), RMSE, MAE and Lin's concordance, population moments throughout."""
    ssr = F.sum((y - p) ** 2)
    sst = F.var_pop(y) * F.count(y)
    return {
        "r2": 1 - ssr / F.greatest(sst, F.lit(TINY)),
        "rmse": F.sqrt(F.avg((y - p) ** 2)),
        "mae": F.avg(F.abs(y - p)),
        "ccc": 2 * F.covar_pop(y, p) / (F.var_pop(y) + F.var_pop(p) + (F.avg(y) - F.avg(p)) ** 2),
    }


def scored(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy by group over rows with an observation."""
    ok = long.filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    return ok.groupBy(*keys).agg(F.count("*").alias("n"), *(c.alias(n) for n, c in accuracy(F.col("y_true"), F.col("y_pred")).items()))


def across_folds(fold_metrics: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mean and population deviation of measures over folds."""
    return fold_metrics.groupBy(*keys).agg(*(x for m in measures for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))))


def brier(p: Column, event: Column) -> Column:
    return F.avg((p - event.cast("double")) ** 2)


def auc(df: DataFrame, keys: Sequence[str], score: str, event: str) -> DataFrame:
    """Mann-Whitney AUC with average ranks; null for one class.  Equal scores are counted
    first, so ties cost nothing."""
    ties = df.groupBy(*keys, score).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("pos"))
    ranked = running(ties, keys, score, ["n"]).withColumn("rank", average_rank(F.col("n"), F.col("before_n")))
    out = ranked.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), F.sum(F.col("rank") * F.col("pos")).alias("w"))
    neg = F.col("n") - F.col("n_pos")
    return out.withColumn("auc", F.when((F.col("n_pos") > 0) & (neg > 0), (F.col("w") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * neg))).drop("w")


def balanced_error(df: DataFrame, keys: Sequence[str], truth: str, guess: str) -> DataFrame:
    """1 - mean recall over the classes that occur, and plain accuracy."""
    by = df.groupBy(*keys, truth).agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("recall"), F.count("*").alias("n"))
    return by.groupBy(*keys).agg((1 - F.avg("recall")).alias("balanced_error"), (F.sum(F.col("recall") * F.col("n")) / F.sum("n")).alias("accuracy"), F.count("*").alias("n_classes"))


def entropy(probs: Column) -> Column:
    """Entropy of an array of probabilities over that of the uniform one; 0 for under two."""
    h = F.aggregate(F.transform(probs, lambda p: clip(p, 1e-12, 1.0)), F.lit(0.0), lambda acc, p: acc - p * F.ln(p))
    return F.when(F.size(probs) < 2, F.lit(0.0)).otherwise(h / F.ln(F.size(probs).cast("double")))


def smoothing(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Variance ratio, mean error, deviations and the regression of observed on predicted."""
    y, p = F.col("y_true"), F.col("y_pred")
    return long.groupBy(*keys).agg(
        (F.var_samp(p) / F.var_samp(y)).alias("smoothing_ratio"),
        F.avg(p - y).alias("mean_error"),
        F.stddev_samp(y).alias("sd_true"),
        F.stddev_samp(p).alias("sd_pred"),
        F.regr_slope(y, p).alias("slope"),
        F.regr_intercept(y, p).alias("intercept"),
    )


def ks(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest gap between the empirical distributions of y_true and y_pred."""
    both = long.select(*keys, F.explode(F.array(F.struct(F.col("y_true").alias("v"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("y_pred").alias("v"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"))
    steps = both.filter("x.v is not null").groupBy(*keys, F.col("x.v").alias("v")).agg(F.sum("x.t").alias("t"), F.sum("x.p").alias("p"))
    at = running(steps, keys, "v", ["t", "p"])
    share = lambda c: (F.col(f"before_{c}") + F.col(c)) / F.col(f"all_{c}")
    return at.withColumn("gap", F.abs(share("t") - share("p"))).groupBy(*keys).agg(F.max("gap").alias("ks"))


def quantile_errors(long: DataFrame, keys: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """(q, q_true, q_pred, error) by group: exact quantiles by linear interpolation."""
    lit = F.array(*(F.lit(q) for q in qs))
    out = quantiles(long, keys, {"t": F.col("y_true"), "p": F.col("y_pred")}, qs)
    rows = out.select(*keys, F.explode(F.arrays_zip(lit.alias("q"), "t", "p")).alias("x"))
    return rows.select(*keys, F.col("x.q").alias("q"), F.col("x.t").alias("q_true"), F.col("x.p").alias("q_pred"), (F.col("x.p") - F.col("x.t")).alias("error"))


def selectivity(long: DataFrame, keys: Sequence[str], points: int = 40) -> DataFrame:
    """Share of rows and their mean value at or above evenly spaced cut-offs between the 2nd and
    98th percentile of y_true, for observations and predictions.

    A row is binned once for each of the two by the cut-offs of its group; the sums of the
    ``points`` + 1 bins of a group are cumulated from above."""
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    span = quantiles(long, keys, {"e": F.col("y_true")}, [0.02, 0.98]).select(*keys, F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi"))
    cuts = span.select(*keys, F.transform(steps, lambda s: F.col("lo") + (F.col("hi") - F.col("lo")) * s / (points - 1)).alias("_c"))
    both = met(long, cuts, keys)
    over = lambda c: F.size(F.filter("_c", lambda x: x <= F.col(c)))
    kinds = F.array(*(F.struct(F.lit(n).alias("kind"), over(c).alias("bin"), F.col(c).alias("v")) for n, c in (("true", "y_true"), ("pred", "y_pred"))))
    bins = both.select(*keys, F.explode(kinds).alias("x")).groupBy(*keys, "x.kind", "x.bin").agg(F.count("x.v").alias("n"), F.sum("x.v").alias("s"))
    rows = bins.groupBy(*keys).agg(*(F.collect_list(F.when(F.col("kind") == n, F.struct("bin", "n", "s"))).alias(n) for n in ("true", "pred")))

    def above(kind: str, what: str) -> Column:
        return F.aggregate(F.array_sort(F.filter(kind, lambda b: b["bin"] > F.col("step"))), F.lit(0).cast("double"), lambda a, b: a + b[what])

    out = met(rows, cuts, keys).select(*keys, "true", "pred", F.posexplode("_c").alias("step", "cutoff"))
    total = lambda kind: F.aggregate(kind, F.lit(0).cast("long"), lambda a, b: a + b["n"])
    part = lambda kind: (above(kind, "n") / total(kind)).alias(f"share_{kind}")
    mean = lambda kind: F.when(above(kind, "n") > 0, above(kind, "s") / above(kind, "n")).alias(f"mean_{kind}")
    return out.select(*keys, "step", "cutoff", part("true"), mean("true"), part("pred"), mean("pred"))


def ecdf(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Every value with its step of the empirical distribution; ties keep steps of their own."""
    return row_numbers(df, keys, value, "node_id").withColumn("ecdf", F.col("place") / F.col("n")).drop("place", "n")


def signed_rank(pairs: DataFrame, keys: Sequence[str], diff: Column) -> DataFrame:
    """Wilcoxon's signed-rank sums over non-zero differences with average ranks, and the normal
    approximation z with tie correction; p by ``p_value``."""
    d = pairs.select(*keys, diff.alias("d")).filter("d <> 0").withColumn("a", F.abs("d"))
    ties = d.groupBy(*keys, "a").agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = running(ties, keys, "a", ["n"]).withColumn("rank", average_rank(F.col("n"), F.col("before_n")))
    n = F.col("n_diff").cast("double")
    out = ranked.groupBy(*keys).agg(F.sum("n").alias("n_diff"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("w_minus"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("_t"))
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_t") / 48
    return out.withColumn("z", F.when(var > 0, (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(var))).drop("_t")


def p_value(z: Column) -> Column:
    """Two-sided p of a standard normal z."""
    return erfc(F.abs(z) / F.sqrt(F.lit(2.0)))


def exact_signed_rank_p(w: float, n: int) -> float:
    """Two-sided exact p of the smaller signed-rank sum for n untied differences."""
    import numpy as np

    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for i in range(1, n + 1):
        ways[i:] += ways[:-i].copy()
    return float(min(1.0, 2 * ways[: int(np.floor(w)) + 1].sum() / 2.0**n))


def kendall_tau(pairs: DataFrame, keys: Sequence[str], item: str, a: str, b: str) -> DataFrame:
    """Tau-b of two rankings of a few items (methods) in each group."""
    rows = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(item, F.col(a).alias("a"), F.col(b).alias("b")))).alias("m"))
    two = rows.select(*keys, "m", F.posexplode("m").alias("p", "x")).select(*keys, "x", F.explode(F.expr("slice(m, p + 2, size(m))")).alias("y"))
    s1, s2 = F.signum(F.col("x.a") - F.col("y.a")), F.signum(F.col("x.b") - F.col("y.b"))
    out = two.groupBy(*keys).agg(F.sum(s1 * s2).alias("s"), F.sum(F.abs(s1)).alias("n1"), F.sum(F.abs(s2)).alias("n2"), F.count("*").alias("n_pairs"))
    return out.withColumn("tau", F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("s") / F.sqrt(F.col("n1") * F.col("n2")))).drop("s", "n1", "n2")
