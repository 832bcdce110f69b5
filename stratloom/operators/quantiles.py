"""Exact quantiles of groups of any size, by selection.

The first pass counts each group's values and finds their ends.  Groups that a task can sort are
done in one aggregation.  For the others rounds of counts narrow, for each rank that is asked
for, the interval that holds it: an interval is cut into ``BINS`` equal parts, rows are counted
by part with partial sums, and the part with the rank, shrunk to the least and largest
value seen in it, is the next interval.  A rank is found when its interval is one value; or when few rows are left of it,
which are then sorted.  No values are shuffled before that, and no buffer holds more than
``FIT`` values or ``BINS`` counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import nan_to_null
from .lineage import settle
from .ranks import met

FIT = 1 << 16
BINS = 1024


def _long(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """(keys, _name, _v): the values to rank, one row each."""
    pairs = F.array(*(F.struct(F.lit(n).alias("n"), nan_to_null(c.cast("double")).alias("v")) for n, c in values.items()))
    return df.select(*keys, F.explode(pairs).alias("_x")).select(*keys, F.col("_x.n").alias("_name"), F.col("_x.v").alias("_v")).filter("_v is not null")


def quantiles(df: DataFrame, keys: Sequence[str], values: dict[str, Column], qs: Sequence[float], *, fit: int = FIT, bins: int = BINS, log: list | None = None) -> DataFrame:
    """(keys, one array of doubles for each of values): the quantiles ``qs`` by linear interpolation.

    Null and NaN count as missing; a group without a value of a kind has null for its array, one
    without any has no row; null keys are a group.  Values are finite.  ``log`` gets the number of
    rows left of each round; ``fit`` and ``bins`` change the plan and never a result."""
    keys = list(keys)
    long = _long(df, keys, values)
    group = [*keys, "_name"]
    ends = settle(long.groupBy(*group).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    lit = F.array(*(F.lit(float(q)) for q in qs))
    largest = ends.agg(F.max("n")).first()[0]
    if largest is None or largest <= fit:
        found = long.groupBy(*group).agg(F.percentile("_v", lit).alias("_a"))
    else:
        found = _interpolated(_selected(long, ends, group, qs, fit, bins, log), group, qs)
    kinds = {n: F.max(F.when(F.col("_name") == n, F.col("_a"))) for n in values}
    return found.groupBy(*keys).agg(*(c.alias(n) for n, c in kinds.items()))


def _ranks(n: Column, qs: Sequence[float]) -> Column:
    """The ranks, from 0, between which the quantiles of n values lie."""
    at = [(n - 1) * F.lit(float(q)) for q in qs]
    return F.array_distinct(F.flatten(F.array(*(F.array(F.floor(a), F.ceil(a)) for a in at))))


def _selected(long: DataFrame, ends: DataFrame, group: list[str], qs: Sequence[float], fit: int, bins: int, log: list | None) -> DataFrame:
    """(group, n, rank, value) of the ranks that the quantiles need."""
    open_ = ends.select(*group, "n", "lo", "hi", F.explode(_ranks(F.col("n"), qs)).alias("rank"), F.lit(0).cast("long").alias("below"), F.col("n").alias("left"))
    done = None
    while True:
        one = open_.filter("lo = hi").select(*group, "n", "rank", F.col("lo").alias("value"))
        done = one if done is None else done.unionByName(one)
        open_ = open_.filter("lo < hi")
        wide = open_.filter(F.col("left") > fit)
        state = wide.agg(F.count("*"), F.max("left")).first()
        if log is not None:
            log.append(state[1] or 0)
        if not state[0]:
            break
        # intervals of a group that are equal are counted once
        spans = wide.select(*group, "lo", "hi").distinct()
        rows = met(long, spans, group).filter(F.col("_v").between(F.col("lo"), F.col("hi")))
        part = F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        counts = rows.groupBy(*group, "lo", "hi", part.alias("part")).agg(F.count("*").alias("c"), F.min("_v").alias("a"), F.max("_v").alias("b"))
        lists = counts.groupBy(*group, "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("part", "c", "a", "b"))).alias("h"))  # bins at most
        held = met(wide.select(*group, "n", "rank", "below", "lo", "hi"), lists, [*group, "lo", "hi"])
        step = F.aggregate(
            "h",
            F.struct(F.col("below").alias("at"), F.lit(None).cast("struct<below: long, c: long, a: double, b: double>").alias("hit")),
            lambda s, x: F.struct((s["at"] + x["c"]).alias("at"), F.when(s["hit"].isNull() & (s["at"] + x["c"] > F.col("rank")), F.struct(s["at"].alias("below"), x["c"].alias("c"), x["a"].alias("a"), x["b"].alias("b"))).otherwise(s["hit"]).alias("hit")),
        )
        then = held.withColumn("_h", step["hit"]).select(*group, "n", F.col("_h.a").alias("lo"), F.col("_h.b").alias("hi"), "rank", F.col("_h.below").alias("below"), F.col("_h.c").alias("left"))
        open_ = settle(open_.filter(F.col("left") <= fit).unionByName(then))
    # what is left of an interval is sorted, each by itself
    spans = open_.select(*group, "lo", "hi", "below").distinct()
    rows = met(long, spans, group).filter(F.col("_v").between(F.col("lo"), F.col("hi")))
    placed = rows.withColumn("rank", F.col("below") - 1 + F.row_number().over(W.partitionBy(*group, "lo", "hi").orderBy("_v")))
    few = met(placed.select(*group, "rank", F.col("_v").alias("value")), open_.select(*group, "n", "rank"), [*group, "rank"]).select(*group, "n", "rank", "value")
    return done.unionByName(few)


def _interpolated(ranks: DataFrame, group: list[str], qs: Sequence[float]) -> DataFrame:
    known = ranks.groupBy(*group).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_set(F.struct(F.col("rank").cast("long"), "value"))).alias("m"))

    def one(q: float) -> Column:
        at = (F.col("n") - 1) * F.lit(float(q))
        low, high = F.col("m")[F.floor(at)], F.col("m")[F.ceil(at)]
        return low * (1 - (at - F.floor(at))) + high * (at - F.floor(at))

    return known.select(*group, F.array(*(one(q) for q in qs)).alias("_a"))
