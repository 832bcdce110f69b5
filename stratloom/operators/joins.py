"""Joins of supports: nearest neighbour within a tolerance, pairings of methods, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


class SupportError(ValueError):
    """Two supports can't be matched without doubt."""


def tolerance_matches(anchor: DataFrame, other: DataFrame, key: str, other_key: str, reach: float = 1.0) -> DataFrame:
    """``key, other_key, dist, rank`` of the pairs within ``reach``; rank 1 is the nearest one.

    Anchors look into the cells of size ``reach`` around theirs, so the join is an equi-join
    on the cell and its size follows the local density only."""
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)))
    left = anchor.select(F.col(key), "x", "y", "z", F.explode(around).alias("o")).select(key, "x", "y", "z", *((F.floor(F.col(a) / reach) + F.col(f"o.{m}")).alias(f"b{a}") for a, m in zip("xyz", "abc", strict=True)))
    right = other.select(F.col(other_key), *(F.col(a).alias(f"o{a}") for a in "xyz"), *(F.floor(F.col(a) / reach).alias(f"b{a}") for a in "xyz"))
    d = F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2 + (F.col("z") - F.col("oz")) ** 2)
    met = left.join(right, ["bx", "by", "bz"]).withColumn("dist", d).filter(F.col("dist") < reach)
    rank = F.row_number().over(W.partitionBy(key).orderBy("dist", other_key))
    return met.select(key, other_key, "dist").withColumn("rank", rank)


def common_support(anchor: DataFrame, other: DataFrame, key: str, other_key: str, tolerance: float = 0.5, ambiguous: float = 1.0) -> DataFrame:
    """The one-to-one matches within the tolerance; raises if a nearest match lies between
    tolerance and ``ambiguous`` or if two anchors share a match."""
    best = tolerance_matches(anchor, other, key, other_key, ambiguous).filter("rank = 1")
    seen = best.agg(F.count_if(F.col("dist") > tolerance).alias("doubt"), F.count_if(F.col("dist") <= tolerance).alias("n"), F.count_distinct(F.when(F.col("dist") <= tolerance, F.col(other_key))).alias("distinct")).first()
    if seen["doubt"]:
        raise SupportError(f"{seen['doubt']} nearest matches between {tolerance} and {ambiguous}")
    if seen["n"] != seen["distinct"]:
        raise SupportError("matches are not one to one")
    return best.filter(F.col("dist") <= tolerance).drop("rank")


def verify_joined(joined: DataFrame, limit: float = 1e-3) -> DataFrame:
    """One row: largest difference of ``y_true`` and ``y_other``, share of equal folds, verdict."""
    out = joined.agg(F.count("*").alias("n"), F.max(F.abs(F.col("y_true") - F.col("y_other"))).alias("max_diff"), F.avg((F.col("fold") == F.col("fold_other")).cast("double")).alias("fold_agreement"))
    return out.withColumn("ok", (F.col("max_diff") <= limit) & (F.col("fold_agreement") == 1.0))


def alignment(a: DataFrame, b: DataFrame, key: str, limit: float = 0.01) -> DataFrame:
    """One row: keys in both, in one only, and whether coordinates agree within the limit."""
    both = a.select(key, *(F.col(c).alias(f"a{c}") for c in "xyz"), F.lit(1).alias("_a")).join(b.select(key, *(F.col(c).alias(f"b{c}") for c in "xyz"), F.lit(1).alias("_b")), key, "full")
    gap = F.greatest(*(F.abs(F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz"))
    return both.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"),
        F.count_if(F.col("_b").isNull()).alias("only_left"),
        F.count_if(F.col("_a").isNull()).alias("only_right"),
        F.max(gap).alias("max_gap"),
    ).withColumn("aligned", (F.col("only_left") + F.col("only_right") == 0) & (F.col("max_gap") <= limit))


def method_pairs(long: DataFrame) -> DataFrame:
    """Rows of two methods on one node: ``target, node_id, method_a, method_b, err_a, err_b``.
    The methods of a node are gathered first, so its pairs are made within one row."""
    rows = long.groupBy("target", "node_id").agg(F.array_sort(F.collect_list(F.struct("method", (F.col("y_pred") - F.col("y_true")).alias("e")))).alias("m"))
    left = rows.select("target", "node_id", "m", F.posexplode("m").alias("p", "a"))
    pair = left.select("target", "node_id", "a", F.explode(F.expr("slice(m, p + 2, size(m))")).alias("b"))
    return pair.select("target", "node_id", F.col("a.method").alias("method_a"), F.col("b.method").alias("method_b"), F.col("a.e").alias("err_a"), F.col("b.e").alias("err_b"))


def provenance_matches(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """field, left, right, same: null-safe equality of the fields of two one-row run records."""
    one = a.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("left")) for f in fields))).alias("x")).select("x.*")
    two = b.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("right")) for f in fields))).alias("x")).select("x.*")
    return one.join(two, "field").withColumn("same", F.col("left").eqNullSafe(F.col("right")))
