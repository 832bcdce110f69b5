"""Operators that spread one group over tasks, against plain Python."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratloom.operators import coherence, folds, grid, metrics, neighbours, quantiles, ranks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- ranks ---


@pytest.fixture(scope="module")
def valued(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(i), float(v)) for g in ("a", "b", None) for i, v in enumerate(np.round(rng.normal(size=400), 2))]
    rows += [("a", 1000 + i, 0.25) for i in range(300)] + [("a", 2000, None), ("b", 2001, float("nan")), ("b", None, 0.5), ("c", 1, 7.0)]
    return spark.createDataFrame(rows, "g string, node_id long, v double").repartition(5)


@pytest.mark.parametrize("parts", [2, 7, 32])
def test_running_totals(valued, parts):
    ties = valued.filter("v is not null").groupBy("g", "v").agg(F.count("*").alias("n"))
    by = collections.defaultdict(list)
    for r in ties.collect():
        by[r.g].append((math.isnan(r.v), r.v if r.v == r.v else 0.0, r.n))
    want = {}
    for g, rows in by.items():
        total = 0
        for nan, v, n in sorted(rows):
            want[g, nan, v] = (total, sum(x[2] for x in rows))
            total += n
    got = ranks.running(ties, ["g"], "v", ["n"], parts).collect()
    assert {(r.g, r.v != r.v, 0.0 if r.v != r.v else r.v): (r.before_n, r.all_n) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("parts", [2, 32])
def test_row_numbers(valued, parts):
    got = ranks.row_numbers(valued, ["g"], "v", "node_id", parts).collect()
    by = collections.defaultdict(list)
    for r in valued.collect():
        by[r.g].append(r)
    order = lambda r: (r.v is None, r.v is not None and r.v != r.v, r.v if r.v is not None and r.v == r.v else 0.0, r.node_id is not None, r.node_id or 0)
    for g, rows in by.items():
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(1, len(rows) + 1)) and {r.n for r in mine} == {len(rows)}
        assert [order(r) for r in mine] == sorted(map(order, rows))


def test_ranks_have_no_window_over_a_whole_group(spark):
    """Six groups keep many partitions busy, and no window has a group alone for its key."""
    df = spark.range(60_000).select((F.col("id") % 6).alias("g"), F.rand(1).alias("v"), F.lit(1).alias("n"), "id")
    ties = df.groupBy("g", "v").agg(F.sum("n").alias("n"))
    text = plan(ranks.running(ties, ["g"], "v", ["n"]))
    windows = [x for x in text.split("\n") if "Window [" in x]
    assert windows and all("_range" in x for x in windows)
    busy = ranks.ranged(ties, ["g"], "v").groupBy("g", "_range").count().collect()
    assert len(busy) == 6 * ranks.PARTS and max(r["count"] for r in busy) < 3 * 60_000 / len(busy)
    long = df.select(F.col("g").alias("method"), F.col("v").alias("y_true"), (F.col("v") * F.col("v")).alias("y_pred"), F.col("id").alias("node_id"))
    for out in (metrics.ks(long, ["method"]), metrics.auc(long.withColumn("e", F.col("y_true") > 0.5), ["method"], "y_pred", "e"), metrics.ecdf(long, ["method"], "y_true"), metrics.signed_rank(long, ["method"], F.col("y_true") - F.col("y_pred"))):
        windows = [x for x in plan(out).split("\n") if "Window [" in x]
        assert windows and all("_range" in x for x in windows)


# --- quantiles ---

QS = [0.0, 0.02, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.mark.parametrize("fit,bins", [(quantiles.FIT, quantiles.BINS), (20, 16), (1, 1024)])
def test_quantiles_equal_numpy(spark, fit, bins):
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(size=900), "ties": np.repeat([1.0, 2.0, 5.0], [500, 3, 200]), "powers": 2.0 ** -np.arange(60.0), "one": np.array([4.0]), "same": np.full(300, -1.5),
        "wide": np.concatenate([rng.normal(size=300), [1e12, -1e12]]), None: np.arange(77.0),
    }
    rows = [(g, float(v), float(-v)) for g, x in groups.items() for v in x] + [("normal", None, float("nan")), ("empty", None, None)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(6)
    log = []
    got = {r.g: r for r in quantiles.quantiles(df, ["g"], {"a": F.col("v"), "b": F.col("w")}, QS, fit=fit, bins=bins, log=log).collect()}
    for g, x in groups.items():
        assert got[g].a == pytest.approx(np.quantile(x, QS).tolist(), rel=1e-12, abs=1e-12)
        assert got[g].b == pytest.approx(np.quantile(-x, QS).tolist(), rel=1e-12, abs=1e-12)
    assert "empty" not in got
    if fit < 900:  # rounds leave ever fewer rows, and end
        assert log and log == sorted(log, reverse=True) and log[-1] == 0 and len(log) < 40
    else:
        assert not log


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles.quantiles(df, ["g"], {"a": F.col("v")}, [0.5]).collect() == []
    assert [r.a for r in quantiles.quantiles(df, [], {"a": F.col("v")}, [0.5]).collect()] in ([], [None])


def test_rounds_shuffle_counts_only(spark):
    """The rows of a round are reduced to counts before the exchange."""
    df = spark.range(200_000).select(F.lit(1).alias("g"), F.rand(2).alias("v"))
    log = []
    r = quantiles.quantiles(df, ["g"], {"a": F.col("v")}, [0.5], fit=1000, log=log).first()
    assert log == [200_000, 0]  # after one round a part has about 195 rows
    assert r.a[0] == pytest.approx(df.agg(F.percentile("v", F.lit(0.5))).first()[0], abs=1e-12)


# --- nearest neighbours ---


def clouds(kind, rng):
    if kind == "even":
        return rng.random((300, 3)) * [100, 80, 20], rng.random((250, 3)) * [100, 80, 20]
    if kind == "far":  # two dense clusters and points far away from both
        t = np.concatenate([rng.normal(size=(200, 3)), rng.normal(size=(200, 3)) * 0.01 + 500])
        return np.concatenate([rng.normal(size=(50, 3)) * 300, t[:30]]), t
    if kind == "flat":
        return rng.random((100, 3)) * [50, 50, 0], np.round(rng.random((120, 3)) * [50, 0, 0])
    return np.full((20, 3), 2.0), np.full((40, 3), 3.0)  # all in one place


@pytest.mark.parametrize("kind,cell", [("even", None), ("even", 200.0), ("flat", 0.7), ("far", None), ("same", None)])
def test_nearest_equals_brute_force(spark, kind, cell):
    rng = np.random.default_rng(7)
    p, t = clouds(kind, rng)
    fp, ft = rng.integers(0, 3, len(p)), rng.integers(0, 3, len(t))
    schema = "node_id int, x double, y double, z double, fold int"
    points = spark.createDataFrame([(i, *map(float, a), int(f)) for i, (a, f) in enumerate(zip(p, fp))] + [(999, None, 1.0, 1.0, 0)], schema)
    targets = spark.createDataFrame([(i, *map(float, a), int(f)) for i, (a, f) in enumerate(zip(t, ft))] + [(999, 1.0, None, 1.0, 0)], schema)
    d = np.sqrt(((p[:, None] - t[None]) ** 2).sum(2))
    got = {r.node_id: r.dist for r in folds.nearest(points, targets, "node_id", cell=cell).collect()}
    assert got.pop(999) is None and got == pytest.approx(dict(enumerate(d.min(1).tolist())), abs=1e-9)
    got = {r.node_id: r.dist for r in folds.nearest(points, targets, "node_id", apart="fold", cell=cell).collect()}
    other = np.where(fp[:, None] == ft[None], np.inf, d).min(1)
    assert got.pop(999) is None and got == pytest.approx(dict(enumerate(other.tolist())), abs=1e-9)
    by = {(r.node_id, r.fold): r.dist for r in folds.nearest_by(points, targets, "node_id", "fold").collect()}
    assert by == pytest.approx({(i, f): float(d[i, ft == f].min()) for i in range(len(p)) for f in set(ft.tolist())}, abs=1e-9)


def test_nearest_without_targets(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1)], "node_id int, x double, y double, z double, fold int")
    assert [r.dist for r in folds.nearest(points, points.filter("false"), "node_id").collect()] == [None]
    assert [r.dist for r in folds.nearest(points, points, "node_id", apart="fold").collect()] == [None]
    assert folds.nearest(points.filter("false"), points, "node_id").collect() == []


def test_places_meet_in_many_cells(spark):
    """At the cells that a search chooses no cell has more than a few targets, also in a cluster."""
    rng = np.random.default_rng(2)
    at = np.concatenate([rng.random((2000, 3)) * 1000, rng.random((2000, 3))])
    spots = spark.createDataFrame([tuple(map(float, a)) for a in at], "x double, y double, z double").withColumn("g", F.lit(1))
    cell, low, levels = neighbours.spacing(spots)
    held = spots.withColumns(neighbours._index(cell, low)).groupBy(*neighbours._CELL).count().collect()
    assert len(held) > 300 and max(r["count"] for r in held) < 100 and cell * 2**levels > 999


# --- component trees ---


@pytest.mark.parametrize("connect,tile", [(6, 4), (26, 4), (6, 32), (26, 5)])
def test_component_tree_equals_search(spark, connect, tile):
    rng = np.random.default_rng(connect + tile)
    level = rng.integers(0, 4, (11, 9, 10)) * (rng.random((11, 9, 10)) < 0.8)
    cells = {(int(a) - 3, int(b) - 3, int(c) - 3): int(level[a, b, c]) for a, b, c in np.ndindex(level.shape)}
    df = spark.createDataFrame([("f", *a, v) for a, v in cells.items()], "g string, i int, j int, k int, level int")
    offsets = grid.face_offsets() if connect == 6 else coherence.ALL
    want, of = {}, {}
    for now in (1, 2, 3):
        seen = {}
        for start in sorted(a for a, v in cells.items() if v >= now):
            todo = [start]
            while todo:
                a = todo.pop()
                if a in seen or cells.get(a, 0) < now:
                    continue
                seen[a] = start
                todo += [tuple(int(x) for x in np.add(a, o)) for o in offsets]
        for start, n in collections.Counter(seen.values()).items():
            want[now, start] = (n, of[start] if now > 1 else None)
        of = seen
    name = lambda a: ":".join(f"{x + (1 << 30):010d}" for x in a)
    got = {(r.level, r.component): (r.size, r.parent) for r in coherence.component_tree(df, ["g"], 3, connect, tile).collect()}
    assert got == {(n, name(a)): (s, p and name(p)) for (n, a), (s, p) in want.items()} and len(got) > 8


def test_component_tree_of_nothing(spark):
    df = spark.createDataFrame([("f", 0, 0, 0, 0)], "g string, i int, j int, k int, level int")
    assert coherence.component_tree(df, ["g"], 2).collect() == []


# --- windows by halo tiles ---


@pytest.mark.parametrize("k,tile", [(3, 16), (3, 4), (5, 16), (5, 3)])
def test_windows_equal_gathering(spark, k, tile):
    rng = np.random.default_rng(k)
    dims, h = (9, 8, 7), k // 2
    cells = {(a, b, c): (None if rng.random() < 0.1 else float(rng.random()), float(rng.random())) for a, b, c in np.ndindex(dims) if rng.random() < 0.7}
    df = spark.createDataFrame([(*a, *v) for a, v in cells.items()], "i int, j int, k int, p double, q double").withColumn("vox", F.lit("clash")).repartition(3)
    want = {}
    for centre in np.ndindex(dims):
        if all(h <= x <= d - 1 - h for x, d in zip(centre, dims)):
            vox = []
            for o, off in enumerate(grid.cube_offsets(k)):
                v = cells.get(tuple(int(x) for x in np.add(centre, off)))
                if v:
                    vox.append((o, v[0] is not None, *v))
            if vox:
                want[centre] = (len(vox), sum(x[1] for x in vox), vox)
    got = {(r.i, r.j, r.k): (r.n_present, r.n_valid, [tuple(x) for x in r.vox]) for r in grid.window_patterns(df, ["p", "q"], dims, k, tile).collect()}
    assert got == want and len(got) > 40


def test_a_cell_travels_less_than_twice(spark):
    df = spark.range(48**3).select(*((F.floor(F.col("id") / 48**p) % 48).cast("int").alias(a) for a, p in (("i", 0), ("j", 1), ("k", 2))))
    for k in (3, 5):
        assert grid.halo(df, 16, k // 2).count() < 2 * 48**3
    assert "Join" not in plan(grid.window_patterns(df.withColumn("v", F.lit(1.0)), ["v"], (48, 48, 48), 5))


# --- folds ---


def test_buffer_groups_and_modes(spark):
    rng = np.random.default_rng(4)
    kernels = {"a": ("g", 3), "b": ("g", 2), "c": ("h", 1)}
    points = [(s, i, *map(float, rng.integers(0, 12, 3) * [5, 5, 2]), None if i % 9 == 0 else int(rng.integers(0, 3))) for s in kernels for i in range(60)]
    df = spark.createDataFrame(points, "dataset string, node_id int, x double, y double, z double, fold int")
    sets = spark.createDataFrame([(s, g, k) for s, (g, k) in kernels.items()], "dataset string, grp string, kernel int")
    got = {(r["mode"], r.dataset, r.node_id, r.f): r.role for r in folds.group_roles(df, sets, 3, (5.0, 5.0, 2.0), safety=2).collect()}
    for mode, extra in (("none", None), ("exact", 0), ("safety", 2)):
        for s, i, x, y, z, fold in points:
            group = kernels[s][0]
            w = None if extra is None else max(k - 1 + extra for g, k in kernels.values() if g == group)
            for f in range(3):
                near = w is not None and any(kernels[t][0] == group and g == f and abs(x - a) <= 5 * w and abs(y - b) <= 5 * w and abs(z - c) <= 2 * w for t, _, a, b, c, g in points)
                assert got[mode, s, i, f] == (-1 if fold is None else 1 if fold == f else 2 if near else 0)
    assert len(got) == 3 * len(points) * 3 and {2} <= set(got.values())


def test_search_folds_scores_its_assignments(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(b), *map(float, rng.random(3) * 50)) for i, b in enumerate(rng.integers(0, 8, 120))]
    nodes = spark.createDataFrame(rows, "node_id int, block int, x double, y double, z double")
    got = folds.search_folds(nodes, 3, trials=15).collect()
    at, block = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows])
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    assert sorted(r.trial for r in got) == list(range(15)) and len({r.folds for r in got}) > 5
    for r in got:
        of = np.array([int(x) for x in r.folds.split(",")])[block]
        n = np.bincount(of, minlength=3)
        assert n.max() - n.min() <= np.bincount(block).max()
        d50 = [np.median(d[of == f][:, of != f].min(1)) for f in range(3)]
        assert r.score == pytest.approx(n.std() / n.mean() + np.std(d50) / np.median(d50), abs=1e-9)
