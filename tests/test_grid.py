import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratloom.operators import coherence, features, folds, grid, joins, metrics, reports


def cells(spark, rows, cols="i int, j int, k int, v double"):
    return spark.createDataFrame(rows, cols)


def test_missing_tokens(spark):
    df = spark.createDataFrame([("-",), (" 1.5 ",), ("NaN",), (None,), ("abc",), ("",), ("2e3",)], "a string")
    assert [r.a for r in grid.missing_to_null(df, ["a"]).collect()] == [None, 1.5, None, None, None, None, 2000.0]


def test_parse_ijk(spark):
    df = spark.createDataFrame([("1_2_3",), ("4-5-6",), ("1,2",), (None,), ("x_y_z",), ("7 8 9",), ("1; 2;3",)], "ijk string")
    got = [(r.pi, r.pj, r.pk, r.i0) for r in grid.parse_ijk(df).collect()]
    assert sorted(g for g in got if g[0] is not None) == [(1, 2, 3, None), (1, 2, 3, None), (4, 5, 6, None), (7, 8, 9, None)]
    whole = grid.parse_ijk(spark.createDataFrame([("3_2_1",), ("4_2_9",)], "ijk string")).collect()
    assert sorted((r.i0, r.j0, r.k0) for r in whole) == [(0, 0, 0), (1, 0, 8)]


def test_index_axis(spark):
    df = spark.createDataFrame([(5.0,), (0.0,), (5.0004,), (10.0,)], "x double")
    assert sorted((r.x, r.n) for r in grid.index_axis(df, "x", "n", 3).collect()) == [(0.0, 0), (5.0, 1), (5.0004, 1), (10.0, 2)]


def cube(spark, missing=()):
    rows = [(i, j, k, None if (i, j, k) in missing else float(i + 10 * j + 100 * k)) for i in range(3) for j in range(3) for k in range(3)]
    return cells(spark, rows, "i int, j int, k int, a double")


def test_window_and_idw_by_hand(spark):
    p = grid.window_patterns(cube(spark, {(0, 0, 0)}), ["a"], (3, 3, 3), 3)
    row = p.collect()
    assert len(row) == 1 and (row[0].n_present, row[0].n_valid) == (27, 26)
    filled = grid.fill_idw(grid.accepted(p), ["a"], 3, (5.0, 5.0, 2.0)).collect()[0].filled
    assert [v.missing for v in filled] == [1] + [0] * 26
    want_s = want_w = 0.0
    for i in range(3):
        for j in range(3):
            for k in range(3):
                if (i, j, k) != (0, 0, 0):
                    w = 1 / (math.sqrt((5 * i) ** 2 + (5 * j) ** 2 + (2 * k) ** 2) + 1e-8) ** 2
                    want_s, want_w = want_s + w * (i + 10 * j + 100 * k), want_w + w
    assert filled[0].a == pytest.approx(want_s / want_w)
    assert filled[1].a == 100.0  # place 1 is k + 1


def test_coverage_rejects_sparse_windows(spark):
    missing = {(i, j, k) for i in range(3) for j in range(3) for k in range(1)}
    p = grid.window_patterns(cube(spark, missing), ["a"], (3, 3, 3), 3)
    assert p.collect()[0].n_valid == 18 and grid.accepted(p).count() == 0


def test_flat_layout(spark):
    p = grid.flatten_patterns(grid.fill_idw(grid.window_patterns(cube(spark), ["a"], (3, 3, 3), 3), ["a"], 3, (1, 1, 1)), ["a"])
    row = p.withColumn("ok", grid.layout_ok(p, 2)).collect()[0]
    assert len(row.features) == 54 and row.ok


def test_rotations_compose_to_identity():
    maps = features.voxel_rotations(3)
    assert maps[0] == list(range(27))
    at = np.arange(27)
    for _ in range(4):
        at = at[np.array(maps[1])]
    assert at.tolist() == list(range(27))
    assert np.arange(27)[np.array(maps[1])][np.array(maps[1])].tolist() == maps[2]


def test_rotation_matrix_is_orthonormal():
    for args in ((30, 20), (0, 90), (200, -35, 40)):
        r = features.rotation_matrix(*args)
        assert np.allclose(r @ r.T, np.eye(3))


def test_decay_pack_covers_every_voxel_once():
    w, masks = features.decay_pack(3, (5, 5, 2), np.eye(3), (20, 10, 5))
    assert sorted(sum(masks, [])) == list(range(27)) and w[13] == 1.0 and max(w) == 1.0 and 13 in masks[0]


def test_impute_and_standardise_use_training_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (0, 100.0), (0, None)], "t int, a double")
    out = features.impute_median(df, ["a"], F.col("t") == 1).collect()
    assert sorted(r.a for r in out) == [1.0, 2.0, 3.0, 100.0]
    z = features.log_standardise(df.filter("a is not null"), ["a"], F.col("t") == 1).filter("t = 1").collect()
    assert sum(r.a for r in z) == pytest.approx(0, abs=1e-9)


def test_block_edges_and_bins(spark):
    assert folds.block_edges(0.0, 115.0, 3, 5.0) == [-2.5, 37.5, 77.5, 117.5]
    df = spark.createDataFrame([(37.4,), (37.5,), (77.5,), (0.0,)], "x double")
    got = df.select(folds.bin_of(F.col("x"), [-2.5, 37.5, 77.5, 117.5]).alias("b")).collect()
    assert [r.b for r in got] == [0, 1, 2, 0]


def test_auto_divisions():
    n = folds.auto_divisions((115, 95, 22), (10, 10, 4), 5)
    assert np.prod(n) >= 15 and all(n)


def test_merge_small():
    import pandas as pd

    s = pd.DataFrame({"block": [0, 1, 2], "n": [20, 3, 30], "x": [0.0, 1.0, 50.0], "y": [0.0] * 3, "z": [0.0] * 3})
    assert folds.merge_small(s, 10) == {0: 0, 1: 0, 2: 2}


def test_greedy_folds_are_balanced():
    sizes = {b: 10 for b in range(10)}
    fold = folds.greedy_folds(sizes, 5, np.random.default_rng(0))
    assert sorted(np.bincount(list(fold.values())).tolist()) == [2] * 5


def test_roles_and_buffer(spark):
    n = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0), (2, 5.0, 0.0, 0.0, 1), (3, 5.1, 5.0, 0.0, 1), (4, 50.0, 0.0, 0.0, 1)], "node_id long, x double, y double, z double, fold int")
    b = folds.buffer_nodes(n, (5.0, 5.0, 2.0))
    assert {(r.node_id, r.fold) for r in b.collect()} == {(2, 0), (1, 1)}  # the boundary counts
    role = {(r.node_id, r.f): r.role for r in folds.roles(n.select("node_id", "fold"), 2, buffered=b).collect()}
    assert role == {(1, 0): 1, (2, 0): 2, (3, 0): 0, (4, 0): 0, (1, 1): 2, (2, 1): 1, (3, 1): 1, (4, 1): 1}


def test_spaced_points():
    at = np.array([[0.0, 0.0], [1.0, 0.0], [5.0, 0.0], [5.5, 0.0], [10.0, 0.0]])
    assert folds.spaced_points(at, 4.0, 10) == [0, 2, 4]


def test_near_join(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 10.0, 0.0, 0.0)], "node_id long, x double, y double, z double")
    b = spark.createDataFrame([(7, 0.2, 0.0, 0.0), (8, 2.0, 0.0, 0.0)], "other_id long, x double, y double, z double")
    assert [(r.node_id, r.other_id) for r in joins.common_support(a, b, "node_id", "other_id").collect()] == [(1, 7)]
    doubt = spark.createDataFrame([(7, 0.7, 0.0, 0.0)], "other_id long, x double, y double, z double")
    with pytest.raises(joins.SupportError):
        joins.common_support(a, doubt, "node_id", "other_id")
    shared = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.3, 0.0, 0.0)], "node_id long, x double, y double, z double")
    with pytest.raises(joins.SupportError):
        joins.common_support(shared, b.filter("other_id = 7"), "node_id", "other_id")


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 3.0), ("a", 3.0, 2.0), ("a", 4.0, None)], "method string, y_true double, y_pred double")
    r = metrics.scored(df, ["method"]).first()
    y, p = np.array([1, 2, 3.0]), np.array([1, 3, 2.0])
    assert r.n == 3 and r.r2 == pytest.approx(1 - 2 / 2) and r.rmse == pytest.approx(math.sqrt(2 / 3))
    assert r.ccc == pytest.approx(2 * np.cov(y, p, ddof=0)[0, 1] / (y.var() + p.var() + (y.mean() - p.mean()) ** 2))


def test_ties_in_auc_and_ks(spark):
    df = spark.createDataFrame([(0.5, True), (0.5, False), (0.9, True), (0.1, False)], "s double, e boolean").withColumn("g", F.lit(1))
    assert metrics.auc(df, ["g"], "s", "e").first().auc == pytest.approx(0.875)
    one = df.filter("e")
    assert metrics.auc(one, ["g"], "s", "e").first().auc is None
    k = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 2.0), (1, 2.0, 2.0), (1, 3.0, 4.0)], "g int, y_true double, y_pred double")
    assert metrics.ks(k, ["g"]).first().ks == pytest.approx(0.25)


def test_signed_rank_and_p(spark):
    d = [3.0, -1.0, 2.0, 2.0, 0.0, -4.0]
    df = spark.createDataFrame([(1, x) for x in d], "g int, x double")
    r = metrics.signed_rank(df, ["g"], F.col("x")).first()
    assert (r.n_diff, r.w_plus, r.w_minus) == (5, 9.0, 6.0)
    assert metrics.exact_signed_rank_p(0, 5) == pytest.approx(0.0625)
    p = spark.range(1).select(metrics.p_value(F.lit(-1.959964)).alias("p")).first().p
    assert p == pytest.approx(0.05, abs=1e-5)


def test_entropy(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([1.0, 0.0],), ([1.0],)], "p array<double>")
    got = [r[0] for r in df.select(metrics.entropy(F.col("p"))).collect()]
    assert got[0] == pytest.approx(1) and got[1] == pytest.approx(0, abs=1e-9) and got[2] == 0


def test_selection(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, None), (1, 2, 0.5), (1, 3, 0.7)], "g int, config_id int, score double")
    got = {r.config_id: (r["rank"], r.selected) for r in reports.rank_configs(df, ["g"]).collect()}
    assert got == {3: (1, True), 0: (2, False), 2: (3, False), 1: (4, False)}


def test_class_edges_are_right_open(spark):
    df = spark.createDataFrame([(34.9,), (35.0,), (65.0,)], "v double")
    assert [r[0] for r in df.select(coherence.classes(F.col("v"), [F.lit(35.0), F.lit(65.0)])).collect()] == [0, 1, 2]


def test_two_blobs(spark):
    rows = [(1, 0, 0, 0), (1, 1, 0, 0), (1, 2, 1, 1), (1, 2, 1, 2)]
    df = spark.createDataFrame(rows, "g int, i int, j int, k int")
    assert coherence.connectivity(df, ["g"], 6).count() == 2
    assert [r.size for r in coherence.connectivity(df, ["g"], 26).collect()] == [4]


def test_components_match_a_search():
    rng = np.random.default_rng(0)
    at = np.argwhere(rng.random((9, 8, 7)) < 0.35)
    for offsets in (grid.face_offsets(), coherence.ALL):
        label = coherence._local_tree(at, np.ones(len(at), int), offsets, 1)[0]
        place = {tuple(a): x for x, a in enumerate(at)}
        seen = {}
        for start in place:
            if start in seen:
                continue
            todo = [start]
            while todo:
                a = todo.pop()
                if a not in place or a in seen:
                    continue
                seen[a] = start
                todo += [tuple(np.add(a, o)) for o in offsets]
        groups = {}
        for a, x in place.items():
            groups.setdefault(seen[a], set()).add(label[x])
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_speck(spark):
    rows = [(1, i, j, k, 2.0 if (i, j, k) == (1, 1, 1) else 0.0) for i in range(3) for j in range(3) for k in range(3)]
    df = spark.createDataFrame(rows, "g int, i int, j int, k int, v double")
    s = {(r.i, r.j, r.k): (r.support, r.n_near) for r in coherence.class_support(df, ["g"]).collect()}
    assert s[1, 1, 1] == (1, 26) and s[0, 0, 0] == (7, 7)
    assert coherence.spikes(df, ["g"]).first().spike3_pct > 0


def test_isolated_cells_survive(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 1.0), (1, 9, 9, 9, 1.0)], "g int, i int, j int, k int, v double")
    assert sorted((r.support, r.n_near) for r in coherence.class_support(df, ["g"]).collect()) == [(1, 0), (1, 0)]


def test_last_write_wins(spark):
    df = spark.createDataFrame([(0, 0, 0, 1, 5.0), (0, 0, 0, 2, 7.0), (1, 0, 0, 1, 9.0)], "i int, j int, k int, t int, v double")
    assert sorted((r.i, r.v, r.n_rows) for r in grid.unique_cells(df, ["t"]).collect()) == [(0, 7.0, 2), (1, 9.0, 1)]


def test_inner_subfolds():
    b = np.repeat([0, 1, 2, 3], 5)
    f = folds.inner_subfolds(b, 2, 0)
    assert all(len(set(f[b == x])) == 1 for x in range(4)) and np.bincount(f).tolist() == [10, 10]
    assert np.bincount(folds.inner_subfolds(np.zeros(9, int), 3, 1)).tolist() == [3, 3, 3]


def test_design_and_rotation_of_features(spark):
    df = spark.createDataFrame([([float(v) for v in range(27)], 5.0)], "f array<double>, s double")
    turned = {r.turn: r.f for r in features.rotate(df, "f", 3, 1).collect()}
    assert turned[0] == [float(v) for v in range(27)] and sorted(turned[1]) == turned[0] and turned[1][13] == 13.0
    assert features.design(df, "f", ["s"], []).first().x == [*map(float, range(27)), 5.0]


def test_fidelity_measures(spark):
    df = spark.createDataFrame([("m", i, float(i), float(i) / 2) for i in range(101)], "method string, node_id int, y_true double, y_pred double")
    s = metrics.smoothing(df, ["method"]).first()
    assert s.smoothing_ratio == pytest.approx(0.25) and s.slope == pytest.approx(2) and s.intercept == pytest.approx(0, abs=1e-9)
    q = {r.q: r.error for r in metrics.quantile_errors(df, ["method"], (0.5, 0.9)).collect()}
    assert q[0.5] == pytest.approx(-25) and q[0.9] == pytest.approx(-45)
    sel = metrics.selectivity(df, ["method"], 5).orderBy("step").collect()
    assert sel[0].cutoff == pytest.approx(2) and sel[-1].cutoff == pytest.approx(98) and sel[-1].share_true == pytest.approx(3 / 101) and sel[-1].mean_pred is None


@pytest.mark.parametrize("connect", [6, 26])
def test_tiles_give_the_same_components(spark, connect):
    rng = np.random.default_rng(connect)
    at = np.argwhere(rng.random((14, 13, 12)) < (0.33 if connect == 6 else 0.1)) - 3
    df = spark.createDataFrame([("f", *map(int, a)) for a in at], "g string, i int, j int, k int")
    one = sorted(r.size for r in coherence.connectivity(df, ["g"], connect).collect())
    assert sorted(r.size for r in coherence.connectivity(df, ["g"], connect, tile=4).collect()) == one and len(one) > 3
