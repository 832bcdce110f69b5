import numpy as np
import pytest
from pyspark.sql import functions as F

from stratloom.operators import features, forest, kriging


def test_split_is_the_midpoint_and_left_is_closed():
    x = np.array([[1.0, 5], [2, 5], [3, 5], [10, 5], [11, 5], [12, 5]])
    y = np.array([[0.0], [0], [0], [1], [1], [1]])
    gain, f, t = forest.best_split(x, y, np.array([0, 1]), 1)
    assert (f, t) == (0, 6.5) and gain == pytest.approx(1.5)
    tree = forest.grow(x, y, np.random.default_rng(0), 2, 1, forest.Mtry("all"))
    assert tree.predict(np.array([[6.5, 0], [6.6, 0]]))[:, 0].tolist() == [0, 1]


def test_gini_equals_sum_of_squares_of_one_hot():
    rng = np.random.default_rng(2)
    x, c = rng.random((40, 1)), rng.integers(0, 3, 40)
    y = np.eye(3)[c]
    gain, f, t = forest.best_split(x, y, np.array([0]), 5)
    gini = lambda k: len(k) * (1 - (np.bincount(k, minlength=3) / len(k)) ** 2 @ np.ones(3))
    best = max(gini(c) - gini(c[x[:, 0] <= v]) - gini(c[x[:, 0] > v]) for v in np.sort(x[:, 0])[4:35])
    assert gain == pytest.approx(best)


def test_mtry_kinds():
    assert [forest.Mtry(v).of(9) for v in (3, 0.5, 1.0, "sqrt", "third", "all", 99)] == [3, 4, 9, 3, 3, 9, 9]
    assert forest.Mtry.parse("1").of(9) == 9 and forest.Mtry.parse("3").of(9) == 3 and forest.Mtry.parse("sqrt").of(9) == 3


def test_empty_node_raises():
    with pytest.raises(ValueError):
        forest.grow(np.zeros((0, 2)), np.zeros((0, 1)), np.random.default_rng(0), 3, 1, forest.Mtry("all"))


def test_forest_learns_and_oob_is_honest():
    rng = np.random.default_rng(3)
    x = rng.random((300, 6))
    y = 5 * x[:, 2] + rng.normal(0, 0.1, 300)
    f = forest.VoxelForest(trees_n=30, depth=8, mtry=forest.Mtry("all")).fit(x, y)
    assert forest.r2(y, f.oob[:, 0]) > 0.9 > forest.r2(rng.permutation(y), f.oob[:, 0])
    mean, std = f.importance(x, y)
    assert int(mean.argmax()) == 2 and (std >= 0).all()


def test_rotation_averaging_is_invariant():
    rng = np.random.default_rng(4)
    turns = features.feature_rotations(3)
    x = rng.random((60, 135))
    f = forest.VoxelForest(trees_n=5, depth=4, turns=turns).fit(x, x[:, 65])
    assert np.allclose(f.predict(x), f.predict(x[:, np.array(turns[1])]))


def test_balanced_classes():
    rng = np.random.default_rng(5)
    x = rng.random((200, 3))
    y = (x[:, 0] > 0.9).astype(int)
    f = forest.VoxelForest(trees_n=20, depth=4, classes=2, balanced=True, mtry=forest.Mtry("all")).fit(x, y)
    p = f.predict(x)
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == y).mean() > 0.95


def test_zone_of_influence(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(135)], "feature int, importance double")
    z = forest.zone_of_influence(rows, 4, 3)
    got = {(r.channel, r.a, r.b, r.c): r.importance for r in z.collect()}
    assert len(got) == 135 and got[0, 0, 0, 0] == 65.0 and got[4, 1, 1, 1] == 134.0


def model(nugget=0.1, kind="exponential"):
    return kriging.Covariance(tuple(map(tuple, np.eye(3))), (50.0, 50.0, 20.0), nugget, kind)


@pytest.mark.parametrize("kind", ["exponential", "matern32"])
def test_whitener(kind):
    at = np.random.default_rng(0).random((30, 3)) * 100
    m = model(kind=kind)
    w = m.whitener(at)
    assert np.allclose(w @ m.matrix(at) @ w.T, np.eye(30), atol=1e-6)


def test_whitener_survives_repeated_points():
    at = np.zeros((5, 3))
    assert np.isfinite(model(nugget=0.0).whitener(at)).all()


def test_gls_tree_with_identity_is_a_mean_tree():
    rng = np.random.default_rng(1)
    x = rng.random((80, 2))
    y = np.where(x[:, 0] < 0.5, 1.0, 3.0) + rng.normal(0, 0.01, 80)
    t = kriging.GlsTree(depth=1, least=5).fit(x, y, np.eye(80), rng)
    assert t.feature[0] == 0 and abs(t.threshold[0] - 0.5) < 0.05
    left = x[:, 0] < t.threshold[0]
    assert t.predict(np.array([[t.threshold[0] - 1e-9, 0.0]]))[0] == pytest.approx(y[left].mean(), abs=1e-3)
    assert t.predict(np.array([[t.threshold[0], 0.0]]))[0] == pytest.approx(y[~left].mean(), abs=1e-3)  # right is closed


def test_kriging_interpolates_without_a_nugget():
    rng = np.random.default_rng(2)
    at = rng.random((25, 3)) * 100
    y = rng.random(25)
    m = model(nugget=0.0)
    w = m.whitener(at)
    alpha = w.T @ (w @ y)
    assert np.allclose(m.cross(at, at) @ alpha, y, atol=1e-4)


def test_krige_plan_equals_numpy(spark):
    rng = np.random.default_rng(3)
    s, n = rng.random((12, 3)) * 40, rng.random((20, 3)) * 40
    alpha = rng.random(12)
    m = model(kind="matern32")
    samples = spark.createDataFrame([(*map(float, p), float(a)) for p, a in zip(s, alpha)], "x double, y double, z double, alpha double")
    nodes = spark.createDataFrame([(i, *map(float, p), 1.0) for i, p in enumerate(n)], "node_id long, x double, y double, z double, m double")
    got = {r.node_id: r.krig for r in kriging.krige(nodes, samples, m).collect()}
    want = 1 + m.cross(n, s) @ alpha
    assert np.allclose([got[i] for i in range(20)], want)


def test_gls_forest_on_a_spatial_signal(spark):
    rng = np.random.default_rng(4)
    at = rng.random((120, 3)) * 100
    x = rng.random(120)
    y = 4 * (x > 0.5) + np.sin(at[:, 0] / 20)
    rows = [(i, *map(float, at[i]), int(i % 3), float(x[i]), float(y[i])) for i in range(120)]
    df = spark.createDataFrame(rows, "node_id long, x double, y double, z double, fold int, a double, t double")
    p = kriging.gls_folds(df, ["a"], "t", 3, model(), trees=6, depth=2).toPandas()
    assert len(p) == 120 and forest.r2(p.y_true.to_numpy(), p.y_pred.to_numpy()) > 0.7
    assert forest.r2(p.y_true.to_numpy(), p.y_krig.to_numpy()) > forest.r2(p.y_true.to_numpy(), p.y_pred.to_numpy())


def test_failed_configurations_rank_last(spark):
    rng = np.random.default_rng(5)
    rows = [("T", i, i % 3, [float(v) for v in rng.random(4)], float(i)) for i in range(45)]
    df = spark.createDataFrame(rows, "target string, node_id long, fold int, features array<double>, y double")
    out = forest.tune_folds(df, [{"trees_n": 3, "depth": 3, "least": 2, "mtry": "all"}, {"trees_n": 3, "depth": 3, "least": 2, "mtry": "what"}], 3).collect()
    assert {(r.config_id, r.status == "ok") for r in out} == {(0, True), (1, False)}
    assert all(r.score is None for r in out if r.config_id == 1)


def test_boosting_fits_and_regularises():
    from stratloom.operators.boosting import Boosted

    rng = np.random.default_rng(6)
    x = rng.random((400, 4))
    y = np.sin(6 * x[:, 1]) + x[:, 3]
    b = Boosted(rounds=80).fit(x[:300], y[:300])
    assert forest.r2(y[300:], b.predict(x[300:])) > 0.9
    flat = Boosted(rounds=80, gamma=1e9).fit(x, y)
    assert all(len(t.feature) == 1 for t in flat.trees)
    assert np.ptp(Boosted(rounds=5, l2=1e9).fit(x, y).predict(x)) < 1e-3


def test_models_survive_a_table(spark, tmp_path):
    from stratloom.sources import models

    rng = np.random.default_rng(7)
    x = rng.random((50, 135))
    f = forest.VoxelForest(trees_n=4, depth=4, turns=features.feature_rotations(3)).fit(x, x[:, 3])
    models.save(spark, str(tmp_path / "m"), {"a": f, "b": f})
    back = models.from_table(spark.read.parquet(str(tmp_path / "m")), "a")
    assert np.allclose(back.predict(x), f.predict(x))
    with pytest.raises(KeyError):
        models.from_table(spark.read.parquet(str(tmp_path / "m")), "c")


def test_variants():
    assert features.Variant().name == "K3_ROT_ORI" and features.Variant(rotations=False).turns() is None
    assert len(features.feature_names(3, ("a",), ("s",))) == 55


def test_spatial_forest_tunes_every_configuration(spark, sf_dir, monkeypatch):
    from stratloom.plans import models

    seen = []
    tune = models.forest.tune_folds
    monkeypatch.setattr(models.forest, "tune_folds", lambda s, configs, *more: seen.append(list(configs)) or tune(s, configs, *more))
    models.spatial_forest(spark, sf_dir)
    assert seen == [models.CONFIGS] and {c["depth"] for c in seen[0]} == {4, 8}


@pytest.mark.parametrize("kind", ["XGB", "BAGGED"])
def test_ensembles_dont_follow_the_layout(spark, kind):
    """Partitions of the fits follow the number of rows; predictions are the same however these lie."""
    from stratloom.operators import ensembles

    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 2))
    rows = [(i, i % 2, float(a + b * b), float(a), float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "node_id long, fold int, y double, a double, b double")
    got = []
    for one in (df.repartition(23, "y"), df.orderBy(-F.col("node_id")).coalesce(1)):
        p = ensembles.predict_folds(one, ["a", "b"], 2, kind, trees=2, depth=2)
        assert p.rdd.getNumPartitions() <= 2
        got.append(sorted(map(tuple, p.collect())))
    assert got[0] == got[1] and len(got[0]) == 90


def test_rows_are_dealt_by_number(spark, monkeypatch):
    from stratloom.operators import ensembles

    monkeypatch.setattr(ensembles, "PART", 30)
    d = ensembles.dealt(spark.range(100).withColumn("v", F.col("id") * 2).repartition(9), "id")
    assert d.rdd.getNumPartitions() == 4 and sorted(map(tuple, d.collect())) == [(i, 2 * i) for i in range(100)]
