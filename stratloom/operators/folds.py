"""Spatial folds: blocks, balanced assignment, roles, buffers and distances.

Rows are binned to blocks by column expressions.  What iterates (merging, assignment, the
search over assignments) works on the summary of the blocks, whose number is fixed by the
layout and not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import digitize
from .lineage import settle
from .neighbours import nearest, nearest_by  # noqa: F401  part of this module's surface
from .quantiles import quantiles


def block_edges(lo: float, hi: float, n: int, cell: float) -> list[float]:
    """n + 1 edges over [lo, hi]; inner ones at half cells, outer ones half a cell beyond."""
    inner = [lo + (np.floor((lo + (hi - lo) * m / n - lo) / cell) + 0.5) * cell for m in range(1, n)]
    return [lo - 0.5 * cell, *map(float, inner), hi + 0.5 * cell]


def auto_divisions(extents: Sequence[float], buffers: Sequence[float], folds: int) -> list[int]:
    """Divisions by axis: blocks of three buffers or more, six at most, then the longest axis is
    split until there are three blocks per fold."""
    n = [int(min(max(np.floor(e / max(3 * b, 1e-9)), 1), 6)) for e, b in zip(extents, buffers, strict=True)]
    while int(np.prod(n)) < 3 * folds:
        n[int(np.argmax([e / d for e, d in zip(extents, n, strict=True)]))] += 1
    return n


def bin_of(col: Column, edges: Sequence[float]) -> Column:
    """Number of inner edges at or below the value, as right-open bins."""
    return digitize(col, edges[1:-1])


def block_id(axes: Sequence[tuple[str, Sequence[float]]]) -> Column:
    out = F.lit(0)
    for name, edges in axes:
        out = out * (len(edges) - 1) + bin_of(F.col(name), edges)
    return out


def block_summary(df: DataFrame, axes: Sequence[str] = ("x", "y", "z")) -> pd.DataFrame:
    """One row per block: count and centre; as many rows as the layout has blocks."""
    return df.groupBy("block").agg(F.count("*").alias("n"), *(F.avg(a).alias(a) for a in axes)).orderBy("block").toPandas()


def merge_small(summary: pd.DataFrame, least: int, axes: Sequence[str] = ("x", "y", "z")) -> dict[int, int]:
    """Block to merged block: the smallest group under ``least`` joins the nearest centre until
    none is left; the smaller id names the union."""
    groups = {int(r.block): [int(r.n), np.array([getattr(r, a) for a in axes])] for r in summary.itertuples()}
    root = {b: b for b in groups}
    while len(groups) > 1:
        small = min(groups, key=lambda b: (groups[b][0], b))
        if groups[small][0] >= least:
            break
        near = min((b for b in groups if b != small), key=lambda b: (float(np.sum((groups[b][1] - groups[small][1]) ** 2)), b))
        keep, gone = min(small, near), max(small, near)
        n1, c1 = groups[keep]
        n2, c2 = groups.pop(gone)
        groups[keep] = [n1 + n2, (c1 * n1 + c2 * n2) / (n1 + n2)]
        root = {b: keep if r == gone else r for b, r in root.items()}
    return root


def route_to_blocks(points: DataFrame, centres: DataFrame, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Adds the block of the nearest centre; the centres are one row per block of a layout."""
    c = centres.select(F.col("block").alias("route"), *(F.col(a).alias(f"_{a}") for a in axes))
    d = sum(((F.col(a) - F.col(f"_{a}")) ** 2 for a in axes), F.lit(0.0))
    near = points.crossJoin(F.broadcast(c)).withColumn("_d", F.round(d, 9))
    keys = points.columns
    return near.groupBy(*keys).agg(F.min(F.struct("_d", "route")).alias("_x")).select(*keys, F.col("_x.route").alias("route"))


def greedy_folds(sizes: dict[int, int], folds: int, rng: np.random.Generator) -> dict[int, int]:
    """Blocks in random order, each to the lightest fold, the lowest one on ties."""
    load = np.zeros(folds, np.int64)
    out = {}
    blocks = sorted(sizes)
    for b in rng.permutation(len(blocks)):
        f = int(np.argmin(load))
        out[blocks[b]] = f
        load[f] += sizes[blocks[b]]
    return out


def assignments(spark: SparkSession, blocks: DataFrame, folds: int, trials: int, seed: int = 42) -> DataFrame:
    """(trial, of): ``trials`` greedy assignments of (block, n) to folds, each an array of (block,
    fold) by block.  A trial takes the blocks in an order of its own, by the SHA-1 of seed, trial and
    block, each to the lightest fold so far, the lowest one on ties."""
    row = blocks.agg(F.collect_list(F.struct(F.col("block").cast("int").alias("block"), F.col("n").cast("long").alias("n"))).alias("blocks"))
    order = F.array_sort(F.transform("blocks", lambda b: F.struct(F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col("trial").cast("string"), b["block"].cast("string"))).alias("h"), b["block"].alias("block"), b["n"].alias("n"))))
    light = lambda acc: F.array_position(acc["load"], F.array_min(acc["load"])).cast("int") - 1

    def take(acc: Column, b: Column) -> Column:
        load = F.transform(acc["load"], lambda x, p: x + F.when(p == light(acc), b["n"]).otherwise(0))
        return F.struct(load.alias("load"), F.array_append(acc["of"], F.struct(b["block"].alias("block"), light(acc).alias("fold"))).alias("of"))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), folds).alias("load"), F.lit(None).cast("array<struct<block: int, fold: int>>").alias("of"))
    start = start.withField("of", F.array().cast("array<struct<block: int, fold: int>>"))
    each = spark.range(trials).select(F.col("id").cast("int").alias("trial")).crossJoin(F.broadcast(row))  # one row, as long as the layout has blocks
    return each.select("trial", F.array_sort(F.aggregate(order, start, take)["of"]).alias("of"))


def search_folds(nodes: DataFrame, folds: int, trials: int = 800, seed: int = 42, weight: float = 1.0) -> DataFrame:
    """(trial, score, folds): count imbalance plus ``weight`` times the imbalance of the median
    distance from test to training samples, for ``trials`` greedy assignments of the blocks of
    nodes (node_id, block, x, y, z); ``folds`` has the folds by ascending block.  The least score, and of these the first trial, wins.

    Distances are searched once, from every sample to the nearest one of every block, as many
    values a sample as the layout has blocks; a trial takes the least over the blocks of other folds."""
    spark = nodes.sparkSession
    sizes = settle(nodes.groupBy("block").agg(F.count("*").alias("n")))
    near = nearest_by(nodes.select("node_id", "x", "y", "z"), nodes.select("block", "x", "y", "z"), "node_id", "block")
    reach = near.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("block", "dist"))).alias("reach"))
    samples = nodes.select("node_id", "block").join(reach, "node_id")
    of = settle(assignments(spark, sizes, folds, trials, seed))
    met = samples.crossJoin(F.broadcast(of))  # trials rows, each as long as the layout has blocks
    met = met.withColumn("own", F.filter("of", lambda b: b["block"] == F.col("block"))[0]["fold"])
    away = F.array_min(F.transform(F.filter("of", lambda b: b["fold"] != F.col("own")), lambda b: F.col("reach")[b["block"]]))
    mids = quantiles(met.select("trial", "own", away.alias("d")), ["trial", "own"], {"d50": F.col("d")}, [0.5]).select("trial", F.col("own").alias("fold"), F.col("d50")[0].alias("d50"))
    loads = of.select("trial", F.explode("of").alias("b")).select("trial", F.col("b.block").alias("block"), F.col("b.fold").alias("fold")).join(F.broadcast(sizes), "block").groupBy("trial", "fold").agg(F.sum("n").alias("n"))
    every = of.select("trial", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    rows = every.join(loads, ["trial", "fold"], "left").join(mids, ["trial", "fold"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    score = F.stddev_pop("n") / F.avg("n") + weight * (F.stddev_pop("d50") / F.greatest(F.median("d50"), F.lit(1e-9)))
    return rows.groupBy("trial").agg(score.alias("score")).join(of.select("trial", F.array_join(F.transform("of", lambda b: b["fold"].cast("string")), ",").alias("folds")), "trial").select("trial", "score", "folds")


def roles(df: DataFrame, folds: int, excluded: Column | None = None, buffered: DataFrame | None = None) -> DataFrame:
    """(row keys, fold, role) for every fold: 1 test, 0 train, 2 buffer, -1 excluded.  ``buffered``
    has the (node_id, fold) that lie in a buffer."""
    ring = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("f"))
    role = F.when(F.col("fold") == F.col("f"), 1).otherwise(0)
    if buffered is not None:
        ring = ring.join(buffered.select("node_id", F.col("fold").alias("f"), F.lit(True).alias("_b")), ["node_id", "f"], "left")
        role = F.when(F.col("fold") == F.col("f"), 1).when(F.col("_b"), 2).otherwise(0)
    if excluded is not None:
        role = F.when(excluded, -1).otherwise(role)
    return ring.withColumn("role", role).drop("_b")


def fold_stats(role_rows: DataFrame) -> DataFrame:
    n = lambda r: F.count_if(F.col("role") == r)
    return role_rows.groupBy(F.col("f").alias("fold")).agg(
        n(0).alias("n_train"),
        n(1).alias("n_test"),
        n(2).alias("n_buffer"),
        n(-1).alias("n_excluded"),
        F.round(100.0 * n(2) / F.greatest(F.count("*") - n(1), F.lit(1)), 6).alias("buffer_pct"),
    )


def buffer_nodes(nodes: DataFrame, radius: tuple[float, float, float]) -> DataFrame:
    """(node_id, fold) of the rows outside of a fold that lie within its test points' scaled
    Chebyshev ball, the boundary included.  Points meet in cells of the radius and the cells
    around, an equi-join whatever the extent."""
    cells = [F.floor(F.col(a) / r).alias(f"b{a}") for a, r in zip("xyz", radius, strict=True)]
    test = nodes.select(*cells, F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"), F.col("fold").alias("tf"))
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)))
    seen = nodes.select("node_id", "x", "y", "z", "fold", *cells, F.explode(around).alias("o"))
    seen = seen.withColumns({f"b{a}": F.col(f"b{a}") + F.col(f"o.{m}") for a, m in zip("xyz", "abc", strict=True)})
    close = (F.abs(F.col("x") - F.col("tx")) <= radius[0]) & (F.abs(F.col("y") - F.col("ty")) <= radius[1]) & (F.abs(F.col("z") - F.col("tz")) <= radius[2])
    return seen.join(test, ["bx", "by", "bz"]).filter(close & (F.col("fold") != F.col("tf"))).select("node_id", F.col("tf").alias("fold")).distinct()


def group_radii(datasets: DataFrame, cell: tuple[float, float, float], safety: int = 1) -> DataFrame:
    """(mode, grp, rx, ry, rz) of the modes that have a buffer, from (dataset, grp, kernel): ``exact`` is the
    overlap of kernels, (kernel - 1) cells, ``safety`` that and ``safety`` cells more; a group
    takes the widest of its members."""
    modes = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(x).alias("extra")) for m, x in (("exact", 0), ("safety", safety))))
    wide = datasets.select("grp", "kernel", F.explode(modes).alias("m")).groupBy("m.mode", "grp").agg(F.max(F.col("kernel") - 1 + F.col("m.extra")).alias("w"))
    return wide.select("mode", "grp", *((F.col("w") * c).alias(f"r{a}") for a, c in zip("xyz", cell, strict=True)))


def group_roles(points: DataFrame, datasets: DataFrame, folds: int, cell: tuple[float, float, float], safety: int = 1) -> DataFrame:
    """(mode, dataset, node_id, f, role) of every point in every fold under the modes ``none``,
    ``exact`` and ``safety``: 1 test, 0 train, 2 within the buffer of a test point of the fold in any
    dataset of its group, -1 excluded (a null fold).

    points: (dataset, node_id, x, y, z, fold).  Points meet in cells of the radius of their mode and
    group and the cells around; test points that share a place are one.  A radius of 0 on an axis holds only its own plane."""
    of = F.broadcast(datasets)  # a row for each dataset of a design
    radii = group_radii(datasets, cell, safety)
    named = points.join(of, "dataset").join(F.broadcast(radii), "grp").filter("fold is not null")
    box = [F.floor(F.col(a) / F.when(F.col(f"r{a}") > 0, F.col(f"r{a}")).otherwise(F.lit(1.0))).alias(f"b{a}") for a in "xyz"]
    radius = [f"r{a}" for a in "xyz"]
    test = named.select("mode", "grp", *box, *(F.col(a).alias(f"t{a}") for a in "xyz"), F.col("fold").alias("f")).distinct()
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)))
    seen = named.select("mode", "grp", "dataset", "node_id", "x", "y", "z", "fold", *radius, *box, F.explode(around).alias("o"))
    seen = seen.withColumns({f"b{a}": F.col(f"b{a}") + F.col(f"o.{m}") for a, m in zip("xyz", "abc", strict=True)})
    close = F.lit(True)
    for a in "xyz":
        close = close & (F.abs(F.col(a) - F.col(f"t{a}")) <= F.col(f"r{a}"))
    held = seen.join(test, ["mode", "grp", "bx", "by", "bz"]).filter(close & (F.col("fold") != F.col("f"))).select("mode", "dataset", "node_id", "f").distinct().withColumn("_b", F.lit(True))
    modes, each = F.array(*map(F.lit, ("none", "exact", "safety"))), F.sequence(F.lit(0), F.lit(folds - 1))
    rows = points.select("dataset", "node_id", "fold", F.explode(modes).alias("mode")).withColumn("f", F.explode(each)).join(held, ["mode", "dataset", "node_id", "f"], "left")
    role = F.when(F.col("fold").isNull(), -1).when(F.col("fold") == F.col("f"), 1).when(F.col("_b"), 2).otherwise(0)
    return rows.select("mode", "dataset", "node_id", "f", role.alias("role"))


def inner_splits(role_rows: DataFrame, least_train: int = 10, least_valid: int = 2, least_splits: int = 2) -> DataFrame:
    """(outer, inner, n_train, n_valid): the other folds within an outer fold's training rows,
    those that are large enough, for outer folds that keep enough of them."""
    train = role_rows.filter("role = 0").select(F.col("f").alias("outer"), "node_id", F.col("fold").alias("own"))
    sizes = train.groupBy("outer", F.col("own").alias("inner")).agg(F.count("*").alias("n_valid"))
    total = train.groupBy("outer").agg(F.count("*").alias("n"))
    ok = sizes.join(total, "outer").withColumn("n_train", F.col("n") - F.col("n_valid")).filter((F.col("n_train") >= least_train) & (F.col("n_valid") >= least_valid))
    return ok.withColumn("_s", F.count("*").over(W.partitionBy("outer"))).filter(F.col("_s") >= least_splits).select("outer", "inner", "n_train", "n_valid")


def inner_subfolds(blocks: np.ndarray, folds: int, outer: int, seed: int = 777) -> np.ndarray:
    """Sub-fold of each training sample of an outer fold: whole blocks to the lightest sub-fold, or
    rows at random if there are fewer blocks than sub-folds."""
    rng = np.random.default_rng(seed + 1000 * outer)
    names, n = np.unique(blocks, return_counts=True)
    if len(names) < folds:
        return rng.permutation(np.arange(len(blocks)) % folds)
    fold = greedy_folds(dict(zip(names.tolist(), n.tolist(), strict=True)), folds, rng)
    return np.array([fold[b] for b in blocks.tolist()])


def random_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Adds ``test`` for the share of rows with the smallest hash of key and seed."""
    return df.withColumn("test", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000)) < int(share * 10_000))


def spaced_points(points: np.ndarray, spacing: float, most: int) -> list[int]:
    """Greedy choice of rows that keep a distance from all chosen before."""
    chosen: list[int] = []
    for i, p in enumerate(points):
        if len(chosen) == most:
            break
        if not chosen or np.sqrt(((points[chosen] - p) ** 2).sum(1)).min() >= spacing:
            chosen.append(i)
    return chosen
