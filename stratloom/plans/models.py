"""Queries that train: forests, ensembles, tuning, deployment.  Learners have no SQL form;
tests hold their kernels against worked cases."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting, ensembles, features, forest, grid, kriging, metrics, reports
from ..operators.lineage import settle
from ..sources import synthetic
from . import lattice as L
from .queries import COV, MODEL, query

CONFIGS = [{"trees_n": 12, "depth": d, "least": n, "mtry": m} for d in (4, 8) for n in (3, 8) for m in ("third", "sqrt")]


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted windows with features, joined with their centres."""
    p = grid.accepted(grid.window_patterns(L.cells(spark, sf_dir), COV, L.DIMS, 3))
    p = grid.flatten_patterns(grid.fill_idw(p, COV, 3, L.CELL), COV).select("i", "j", "k", "features")
    return p.join(L.cells(spark, sf_dir).select("i", "j", "k", "node_id", "x", "y", "z", "fold", "dtr", "magnetic"), ["i", "j", "k"])


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, node_id, fold, features, y) of the training rows: some hundreds."""
    p = _patterns(spark, sf_dir).filter("dtr is not null and magnetic is not null")
    two = F.array(F.struct(F.lit("DTR").alias("target"), F.col("dtr").alias("y")), F.struct(F.lit("MAG").alias("target"), F.col("magnetic").alias("y")))
    return p.select("node_id", "fold", "features", F.explode(two).alias("t")).select("t.target", "node_id", "fold", "features", "t.y")


@query()
def tune_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configuration scored on inner folds of every outer fold, ranked."""
    t = forest.tune_folds(_samples(spark, sf_dir), CONFIGS, L.FOLDS, features.feature_rotations(3))
    return reports.rank_configs(t, ["target", "fold"])


@query()
def spatial_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the voxel forest's winners on the folds that tuning never saw."""
    s = _samples(spark, sf_dir)
    turns = features.feature_rotations(3)
    chosen = reports.rank_configs(forest.tune_folds(s, CONFIGS, L.FOLDS, turns), ["target", "fold"]).filter("selected")
    long = forest.refit_folds(s, chosen, CONFIGS, turns, thresholds=(25.0,)).withColumn("method", F.lit("VOXEL"))
    return metrics.scored(long, ["target", "method"])


@query()
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone of influence: the importance of every voxel and covariate for DTR, fitted on the
    driver from the few hundred training rows."""
    s = _samples(spark, sf_dir).filter("target = 'DTR'").orderBy("node_id").toPandas()
    x, y = np.stack(s["features"].to_numpy()), s["y"].to_numpy(float)
    mean, _ = forest.VoxelForest(trees_n=12, depth=6, mtry=forest.Mtry("third"), turns=features.feature_rotations(3)).fit(x, y).importance(x, y)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(mean)], "feature int, importance double")
    return forest.zone_of_influence(rows, len(COV), 3)


@query()
def deploy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voxel forest, refitted on all training rows, on every accepted window."""
    s = _samples(spark, sf_dir).filter("target = 'DTR'").orderBy("node_id").toPandas()
    f = forest.VoxelForest(trees_n=20, depth=8, turns=features.feature_rotations(3)).fit(np.stack(s["features"].to_numpy()), s["y"].to_numpy(float))
    d = forest.deploy(_patterns(spark, sf_dir), f, (25.0, 30.0))
    return d.select("node_id", "y_pred", "y_unc", F.col("p_above")[0].alias("p_gt25"), F.col("p_above")[1].alias("p_gt30"))


@query()
def class_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-bag class probabilities of a balanced classification forest, with entropy."""
    s = _samples(spark, sf_dir).filter("target = 'DTR'").orderBy("node_id").toPandas()
    y = np.digitize(s["y"].to_numpy(float), np.quantile(s["y"], [0.33, 0.67]))
    f = forest.VoxelForest(trees_n=20, depth=6, classes=3, balanced=True, turns=features.feature_rotations(3)).fit(np.stack(s["features"].to_numpy()), y)
    ok = np.isfinite(f.oob[:, 0])
    rows = [(int(n), int(c), [float(v) for v in p]) for n, c, p in zip(s["node_id"][ok], y[ok], f.oob[ok], strict=True)]
    p = spark.createDataFrame(rows, "node_id long, class int, p array<double>")
    return p.withColumns({"entropy": metrics.entropy(F.col("p")), "guess": (F.array_position("p", F.array_max("p")) - 1).cast("int")})


def _support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cells(spark, sf_dir).filter("dtr is not null and valid").select("node_id", "x", "y", "z", "fold", *COV, F.col("dtr"))


@query()
def gls_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold accuracy of the forest under correlated errors, with and without kriged residuals."""
    p = kriging.gls_folds(_support(spark, sf_dir), list(COV), "dtr", L.FOLDS, MODEL, trees=8, depth=3)
    two = F.array(F.struct(F.lit("MEAN").alias("method"), F.col("y_pred").alias("p")), F.struct(F.lit("KRIGED").alias("method"), F.col("y_krig").alias("p")))
    return metrics.scored(p.select("y_true", F.explode(two).alias("m")).select("y_true", "m.method", F.col("m.p").alias("y_pred")), ["method"])


def _ensemble(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...]) -> DataFrame:
    s = settle(_support(spark, sf_dir).withColumnRenamed("y", "north").withColumnRenamed("dtr", "y"))  # lines are read once
    out = None
    for kind in kinds:
        p = ensembles.predict_folds(s, COV, L.FOLDS, kind, trees=10, depth=5)
        out = p if out is None else out.unionByName(p)
    return metrics.scored(out, ["method"])


@query()
def mllib_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark ML forests with and without coordinates, and bagged trees."""
    return _ensemble(spark, sf_dir, ("RF", "RF_XYZ", "BAGGED"))


@query()
def mllib_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark ML boosting, plain and with feature subsampling."""
    return _ensemble(spark, sf_dir, ("GBM", "XGB"))


@query()
def synthetic_deposit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the synthetic deposit: nodes, covered ones, sampled ones."""
    d = synthetic.deposit(spark, (20, 16, 24), holes=20)
    return d.agg(F.count("*").alias("n"), F.count("Fe").alias("covered"), F.count("DTR").alias("sampled"), F.avg("Fe").alias("fe"))


@query()
def deploy_gls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest under correlated errors, refitted on all samples, over all cells."""
    s = _support(spark, sf_dir).orderBy("node_id").toPandas()
    f = kriging.GlsForest(MODEL, trees=6, depth=3).fit(s[list(COV)].to_numpy(float), s["dtr"].to_numpy(float), s[["x", "y", "z"]].to_numpy(float))
    nodes = L.cells(spark, sf_dir).filter("valid").select("node_id", "x", "y", "z", *COV)
    return kriging.deploy_gls(nodes, f, list(COV))


@query()
def xgb_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold accuracy of regularised second-order boosting."""
    s = _support(spark, sf_dir).withColumnRenamed("y", "north").withColumnRenamed("dtr", "y")
    p = boosting.predict_folds(s, COV, L.FOLDS, rounds=40, depth=3)
    return metrics.scored(p.withColumn("method", F.lit("XGB")), ["method"])
