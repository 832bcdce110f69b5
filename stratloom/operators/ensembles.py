"""Conventional tree ensembles of Spark ML on node tables: forest, with coordinates, bagging, boosting.

These are histogram learners (``maxBins``) with a depth of 30 at most and without
out-of-bag estimates; they stand beside the numpy forests, not in their place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import impute_median
from .lineage import settle

PART = 1 << 16  # rows of a partition


def estimator(kind: str, seed: int = 42, trees: int = 30, depth: int = 8, least: int = 3):
    common = {"labelCol": "y", "featuresCol": "vector", "predictionCol": "y_pred", "seed": seed, "maxDepth": depth, "minInstancesPerNode": least}
    if kind in ("RF", "RF_XYZ"):
        return RandomForestRegressor(numTrees=trees, featureSubsetStrategy="onethird", subsamplingRate=1.0, **common)
    if kind == "BAGGED":
        return RandomForestRegressor(numTrees=trees, featureSubsetStrategy="all", subsamplingRate=1.0, **common)
    if kind == "GBM":
        return GBTRegressor(maxIter=trees, stepSize=0.1, subsamplingRate=0.8, **{**common, "maxDepth": min(depth, 4)})
    if kind == "XGB":  # the nearest built-in: feature subsampling per split
        return GBTRegressor(maxIter=trees, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="onethird", **{**common, "maxDepth": min(depth, 4)})
    raise ValueError(f"unknown ensemble {kind}")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows in as many partitions as their number asks for, by key and in order, kept.  A fit runs
    hundreds of stages, each with a task and its report for every partition, and draws its samples by
    partition and place: neither follows how the rows came about."""
    rows = settle(rows)
    parts = max(1, -(-rows.count() // PART))
    order = [key, *(c for c in rows.columns if c != key)]
    return rows.repartition(parts, key).sortWithinPartitions(*order).persist()  # read by every fit; an executor's loss costs a new scan


def predict_folds(samples: DataFrame, features: Sequence[str], folds: int, kind: str, **options) -> DataFrame:
    """(node_id, fold, method, y_true, y_pred): every sample predicted by the model of the other
    folds.  Medians for missing values come from the training rows; ``x, north, z`` are appended for
    RF_XYZ only."""
    cols = [*features, *(("x", "north", "z") if kind == "RF_XYZ" else ())]
    data = dealt(samples.select("node_id", "fold", "y", *cols), "node_id")
    parts = []
    for f in range(folds):
        train = F.col("fold") != f
        filled = impute_median(data, list(cols), train)
        vector = VectorAssembler(inputCols=list(cols), outputCol="vector").transform(filled)
        model = estimator(kind, **options).fit(vector.filter(train))
        parts.append(model.transform(vector.filter(~train)).select("node_id", "fold", F.lit(kind).alias("method"), F.col("y").alias("y_true"), "y_pred"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
