"""Selection of configurations, marginal effects, paired effects and pivoted reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def config_grid(spark, **levels: Sequence) -> DataFrame:
    """The product of the levels with a stable ``config_id`` in the order of the product."""
    import itertools

    names = list(levels)
    rows = [(i, *values) for i, values in enumerate(itertools.product(*levels.values()))]
    return spark.createDataFrame(rows, ["config_id", *names])


def rank_configs(scores: DataFrame, keys: Sequence[str], score: str = "score", id_col: str = "config_id") -> DataFrame:
    """Adds ``rank`` by score, failed ones (null) last, ties by id, and ``selected``."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(id_col)))
    return scores.withColumn("rank", rank).withColumn("selected", F.col("rank") == 1)


def dual_selection(scores: DataFrame, keys: Sequence[str], criteria: Sequence[str], id_col: str = "config_id") -> DataFrame:
    """For each criterion (such as cross-validated and out-of-bag scores) its rank and whether it
    selects the row; ties by id, failed rows last."""
    for c in criteria:
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(c).desc_nulls_last(), F.col(id_col)))
        scores = scores.withColumn(f"rank_{c}", rank).withColumn(f"selected_{c}", F.col(f"rank_{c}") == 1)
    return scores


def fixed_design(scores: DataFrame, keys: Sequence[str], where: Column, score: str = "score", id_col: str = "config_id") -> DataFrame:
    """The best row of each group among the configurations of one design."""
    return best(scores.filter(where), keys, score, id_col)


def best(df: DataFrame, keys: Sequence[str], score: str, id_col: str) -> DataFrame:
    """The row with the largest score of each group, the smallest id on ties."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(id_col)))
    return df.withColumn("_r", first).filter("_r = 1").drop("_r")


def modal_config(selected: DataFrame, keys: Sequence[str], config: str, score: str) -> DataFrame:
    """The configuration selected most often; ties by the better mean score, then by name."""
    n = selected.groupBy(*keys, config).agg(F.count("*").alias("times"), F.avg(score).alias("mean_score"))
    first = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("times").desc(), F.col("mean_score").desc_nulls_last(), F.col(config)))
    return n.withColumn("_r", first).filter("_r = 1").drop("_r")


def mean_scores(scores: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Mean, deviation and count over folds by configuration (null levels are levels), ranked."""
    out = scores.groupBy(*keys).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.count(score).alias("n"))
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.col("mean").desc_nulls_last(), *keys)))  # one row per configuration


def marginal_effects(scores: DataFrame, factors: Sequence[str], score: str = "score") -> DataFrame:
    """(factor, level, median, q25, q75, max) over all runs with that level."""
    cells = F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors))
    long = scores.select(F.explode(cells).alias("x"), score).select("x.*", score)
    q = F.percentile(score, F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75)))
    out = long.groupBy("factor", "level").agg(q.alias("q"), F.max(score).alias("max"))
    return out.select("factor", "level", F.col("q")[0].alias("median"), F.col("q")[1].alias("q25"), F.col("q")[2].alias("q75"), "max")


def boundary_flags(effects: DataFrame) -> DataFrame:
    """(factor, best_level, flag): whether the level with the best median is at an end of the range."""
    level = F.col("level").try_cast("double")
    rows = effects.groupBy("factor").agg(F.min(level).alias("lo"), F.max(level).alias("hi"), F.max(F.struct("median", F.negative(level).alias("neg"))).alias("x"))
    top = F.negative(F.col("x.neg"))
    return rows.select("factor", top.alias("best_level"), F.when(top == F.col("lo"), "low").when(top == F.col("hi"), "high").otherwise("inside").alias("flag"))


def paired_effects(scores: DataFrame, factor: str, low, high, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Mean difference high - low over matched runs and the number of wins."""
    pair = scores.groupBy(*keys).agg(F.max(F.when(F.col(factor) == low, F.col(score))).alias("_lo"), F.max(F.when(F.col(factor) == high, F.col(score))).alias("_hi")).filter("_lo is not null and _hi is not null")
    d = F.col("_hi") - F.col("_lo")
    return pair.agg(F.lit(factor).alias("factor"), F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.count_if(d > 0).alias("wins"))


def pivoted(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, cell: Column) -> DataFrame:
    return df.groupBy(*rows).pivot(column, list(values)).agg(cell)


def fingerprint(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row: the first 16 hex digits of a SHA-1 over the hashes of all rows, in key order of
    256 buckets that are summed, so no task sees all rows."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in (*keys, *cols)))
    part = F.conv(F.substring(F.sha1(text), 1, 12), 16, 10).cast("decimal(38,0)")
    sums = df.select(F.substring(F.sha1(F.concat_ws("|", *(F.col(c).cast("string") for c in keys))), 1, 2).alias("b"), part.alias("p")).groupBy("b").agg(F.sum("p").alias("s"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "s"))), lambda x: F.concat(x["b"], F.lit(":"), x["s"].cast("string"))), ",")
    return sums.agg(F.substring(F.sha1(line), 1, 16).alias("fingerprint"))
