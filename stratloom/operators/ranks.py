"""Ranks and running totals of groups that are larger than a task.

A group's values are cut into ranges by approximate quantiles (a mergeable sketch, so one
aggregation finds the cuts of all groups).  A row's running total is the total of the ranges before
its own, of which a group has ``PARTS`` at most, and a running sum within its range.  So the only windows are over
(group, range); a group of any size is spread over as many tasks as it has ranges.  The cuts
decide where work goes and never a result, as a value lies in one range whatever they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PARTS = 32


def ranged(df: DataFrame, keys: Sequence[str], value: str, parts: int = PARTS) -> DataFrame:
    """Adds ``_range``: how many of the ``parts`` - 1 cuts of its group lie below the row's value."""
    cuts = F.array(*(F.lit(p / parts) for p in range(1, parts)))
    groups = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, cuts, 50 * parts)).alias("_cuts"))
    return met(df, groups, keys).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def met(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the columns of one row per group, null keys meeting null keys.  No hint: the groups are
    broadcast where their size is known to be small, else both sides shuffle."""
    names = {k: f"_k_{k}" for k in keys}
    side = groups.withColumnsRenamed(names)
    on = F.lit(True)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return df.join(side, on).drop(*names.values())


def before(sums: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """From (keys, _range, measures), a row for each range of a group: the totals of the ranges before
    as ``_b_`` columns and of the group as ``_t_`` columns.  A group has few ranges, so its row of
    them is an array and no window is needed."""
    row = F.struct("_range", *measures)
    lists = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_r"), *(F.sum(m).alias(f"_t_{m}") for m in measures))
    out = lists.select(*keys, "_r", *(f"_t_{m}" for m in measures), F.posexplode("_r").alias("_p", "_x"))
    earlier = F.slice("_r", F.lit(1), F.col("_p"))
    total = lambda m: F.aggregate(earlier, F.lit(0).cast(sums.schema[m].dataType), lambda a, x: a + x[m])
    return out.select(*keys, F.col("_x._range").alias("_range"), *(total(m).alias(f"_b_{m}") for m in measures), *(f"_t_{m}" for m in measures))


def running(df: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str], parts: int = PARTS) -> DataFrame:
    """df, in which a group has each value once, with ``before_<m>`` (the total of m over smaller values of
    the group) and ``all_<m>`` (over the group) for each of measures.

    Null values aren't ranked and have no row; null keys are a group; NaN counts as the largest."""
    cut = ranged(df.filter(F.col(value).isNotNull()), keys, value, parts)
    sums = cut.groupBy(*keys, "_range").agg(*(F.sum(m).alias(m) for m in measures))
    # exact measures keep their type, so totals before and within add up
    within = W.partitionBy(*keys, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    local = cut.withColumns({f"_w_{m}": F.sum(m).over(within) for m in measures})
    out = met(local, before(sums, keys, measures), [*keys, "_range"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*df.columns, *((F.col(f"_b_{m}") + zero(f"_w_{m}")).alias(f"before_{m}") for m in measures), *(F.col(f"_t_{m}").alias(f"all_{m}") for m in measures))


def row_numbers(df: DataFrame, keys: Sequence[str], value: str, tie: str, parts: int = PARTS) -> DataFrame:
    """df with ``place`` (from 1, by value and then tie within the group) and ``n`` (rows of the group).

    Equal values, which may be a third of all rows, are dealt by ranges of ``tie`` as well.  Null values come last, null
    ties first; rows equal in both have places in any order."""
    least = df.withColumn("_null", F.col(value).isNull())
    keys = list(keys)
    cut = ranged(least, keys, tie, parts)
    cut = cut.withColumn("_range", F.when(F.col(tie).isNull(), -1).otherwise(F.col("_range")))
    parts_of = cut.groupBy(*keys, "_null", value, "_range").agg(F.count("*").alias("_n"))
    values = parts_of.groupBy(*keys, "_null", value).agg(F.sum("_n").alias("_n"))
    known = running(values.filter(F.col(value).isNotNull()), keys, value, ["_n"], parts)
    sizes = values.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col(value).isNotNull(), F.col("_n")).otherwise(0)).alias("_known"))
    within = before(parts_of.drop("_null"), [*keys, value], ["_n"]).drop("_t__n")
    out = met(cut, within, [*keys, value, "_range"])
    offsets = met(values.drop("_n"), sizes, keys)
    offsets = met_left(offsets, known.select(*keys, value, "before__n"), [*keys, value]).withColumn("_o", F.coalesce("before__n", "_known")).select(*keys, value, "_o", "n")
    out = met(out, offsets, [*keys, value])
    local = F.row_number().over(W.partitionBy(*keys, value, "_range").orderBy(F.col(tie).asc_nulls_first()))
    return out.withColumn("place", F.col("_o") + F.col("_b__n") + local).select(*df.columns, "place", "n")


def met_left(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As ``met``, with the rows of df that have no group."""
    names = {k: f"_k_{k}" for k in keys}
    on = F.lit(True)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return df.join(side.withColumnsRenamed(names), on, "left").drop(*names.values())


def average_rank(n: Column, below: Column) -> Column:
    """The mean rank of n equal values above ``below`` smaller ones."""
    return below + (n + 1) / 2
