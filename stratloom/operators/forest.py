"""The voxel-pattern forest: trees in numpy, fits and predictions as Spark tasks.

A training set has a few hundred patterns, so Spark runs fits side by side (fold, target,
configuration) and each is a numpy kernel; prediction over many nodes goes batch by batch
with the fitted arrays broadcast.  A row with x <= threshold goes left.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mtry:
    """How many features a split looks at: an integer counts, a float is a fraction, and the
    words sqrt, third and all stand for themselves."""

    value: int | float | str = "third"

    def of(self, features: int) -> int:
        v = self.value
        if v == "all":
            n = features
        elif v == "sqrt":
            n = int(np.sqrt(features))
        elif v == "third":
            n = features // 3
        elif isinstance(v, float):
            n = int(v * features)
        else:
            n = int(v)
        return min(max(n, 1), features)

    @staticmethod
    def parse(text: str) -> "Mtry":
        """From a table of results: 1 and 1.0 are the whole, other integers count."""
        if text in ("sqrt", "third", "all"):
            return Mtry(text)
        v = float(text)
        return Mtry(v if v <= 1 else int(v))


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # nodes by outputs

    def apply(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            rows = np.flatnonzero(self.feature[at] >= 0)
            if not len(rows):
                return at
            a = at[rows]
            at[rows] = np.where(x[rows, self.feature[a]] <= self.threshold[a], self.left[a], self.right[a])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.apply(x)]


def best_split(x: np.ndarray, y: np.ndarray, features: np.ndarray, least: int) -> tuple[float, int, float]:
    """(gain, feature, midpoint) of the largest decrease of the sum of squares of the columns of
    y over all given features at once; for one-hot classes that is n times the Gini decrease."""
    n = len(y)
    order = np.argsort(x[:, features], axis=0, kind="stable")
    xs = np.take_along_axis(x[:, features], order, 0)
    sums = np.cumsum(y[order], axis=0)[:-1]  # n - 1 by features by outputs
    k = np.arange(1, n)[:, None]
    total = y.sum(0)
    score = (sums**2).sum(2) / k + ((total - sums) ** 2).sum(2) / (n - k)
    ok = (xs[1:] > xs[:-1]) & (k >= least) & (n - k >= least)
    score = np.where(ok, score, -np.inf)
    at = np.unravel_index(int(score.argmax()), score.shape)
    if not np.isfinite(score[at]):
        return 0.0, -1, 0.0
    lo, hi = xs[at[0], at[1]], xs[at[0] + 1, at[1]]
    mid = lo + (hi - lo) / 2
    return float(score[at] - (total**2).sum() / n), int(features[at[1]]), float(mid if mid < hi else lo)


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int, mtry: Mtry, min_gain: float = 1e-6) -> Tree:
    """A tree on rows x and outputs y (rows by outputs), nodes in the order they are made."""
    if not len(x):
        raise ValueError("a tree needs rows")
    feature, threshold, left, right, value = [-1], [0.0], [-1], [-1], [y.mean(0)]
    todo = [(0, np.arange(len(x)), 0)]
    take = mtry.of(x.shape[1])
    while todo:
        node, rows, level = todo.pop()
        if level >= depth or len(rows) < 2 * least:
            continue
        names = rng.choice(x.shape[1], take, replace=False)
        gain, f, t = best_split(x[rows], y[rows], names, least)
        if f < 0 or gain < min_gain:
            continue
        side = x[rows, f] <= t
        k = len(feature)
        feature[node], threshold[node], left[node], right[node] = f, t, k, k + 1
        for part in (rows[side], rows[~side]):
            feature.append(-1)
            threshold.append(0.0)
            left.append(-1)
            right.append(-1)
            value.append(y[part].mean(0))
        todo += [(k + 1, rows[~side], level + 1), (k, rows[side], level + 1)]
    return Tree(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value))


@dataclass
class VoxelForest:
    """Bootstrap of patterns; each draw takes one of the pattern's rotations at random; out-of-bag
    estimates per pattern; predictions average over trees and over the rotations."""

    trees_n: int = 50
    depth: int = 8
    least: int = 3
    mtry: Mtry = field(default_factory=Mtry)
    seed: int = 999
    classes: int = 0  # 0: regression
    balanced: bool = False
    turns: list[list[int]] | None = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> "VoxelForest":
        n = len(x)
        target = np.eye(self.classes)[y.astype(int)] if self.classes else y[:, None].astype(float)
        turns = [np.array(t) for t in (self.turns or [list(range(x.shape[1]))])]
        total, seen = np.zeros_like(target), np.zeros(n)
        self.trees = []
        self.out = []
        for t in range(self.trees_n):
            rng = np.random.default_rng(self.seed + t)
            if self.balanced and self.classes:
                groups = [np.flatnonzero(y == c) for c in range(self.classes)]
                groups = [g for g in groups if len(g)]
                rows = np.concatenate([rng.choice(g, max(n // len(groups), 1)) for g in groups])
            else:
                rows = rng.integers(0, n, n)
            turn = rng.integers(0, len(turns), len(rows))
            drawn = np.empty((len(rows), x.shape[1]))
            for k, p in enumerate(turns):
                drawn[turn == k] = x[rows[turn == k]][:, p]
            tree = grow(drawn, target[rows], rng, self.depth, self.least, self.mtry)
            self.trees.append(tree)
            out = np.setdiff1d(np.arange(n), rows)
            self.out.append(out)
            total[out] += tree.predict(x[out])
            seen[out] += 1
        self.oob = np.where(seen[:, None] > 0, total / np.maximum(seen, 1)[:, None], np.nan)
        return self

    def each(self, x: np.ndarray) -> np.ndarray:
        """Trees by rows by outputs, averaged over the rotations."""
        turns = [np.array(t) for t in (self.turns or [list(range(x.shape[1]))])]
        return np.array([np.mean([t.predict(x[:, p]) for p in turns], 0) for t in self.trees])

    def predict(self, x: np.ndarray) -> np.ndarray:
        mean = self.each(x).mean(0)
        return mean if self.classes else mean[:, 0]

    def importance(self, x: np.ndarray, y: np.ndarray, cap: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation over trees of the loss that shuffling a feature of a tree's
        out-of-bag rows (``cap`` at most) adds."""
        target = np.eye(self.classes)[y.astype(int)] if self.classes else y[:, None].astype(float)
        rows = []
        for t, (tree, out) in enumerate(zip(self.trees, self.out, strict=True)):
            rng = np.random.default_rng(self.seed + 10_000 + t)
            out = rng.choice(out, cap, replace=False) if len(out) > cap else out
            if not len(out):
                continue
            base = ((tree.predict(x[out]) - target[out]) ** 2).sum(1).mean()
            row = np.zeros(x.shape[1])
            for j in np.unique(tree.feature[tree.feature >= 0]):
                z = x[out].copy()
                z[:, j] = z[rng.permutation(len(out)), j]
                row[j] = ((tree.predict(z) - target[out]) ** 2).sum(1).mean() - base
            rows.append(row)
        rows = np.array(rows) if rows else np.zeros((1, x.shape[1]))
        return rows.mean(0), rows.std(0)


def r2(y: np.ndarray, p: np.ndarray) -> float:
    ok = np.isfinite(p)
    return float(1 - ((y[ok] - p[ok]) ** 2).sum() / max(((y[ok] - y[ok].mean()) ** 2).sum(), 1e-300)) if ok.sum() > 1 else float("nan")


def frames(part: pd.DataFrame) -> np.ndarray:
    return np.stack(part["features"].to_numpy()) if len(part) else np.zeros((0, 1))


def tune_folds(samples: DataFrame, configs: Sequence[dict], folds: int, turns: list[list[int]] | None = None, seed: int = 123) -> DataFrame:
    """(target, fold, config_id, score, oob, status): every configuration scored by R2 pooled over
    the other folds as inner splits; one task per target, outer fold and configuration.  A
    configuration that fails in one split has failed."""
    held = samples.sparkSession.sparkContext.broadcast((list(configs), turns))
    jobs = F.explode(F.sequence(F.lit(0), F.lit(folds * len(configs) - 1)))
    rows = samples.select("target", "node_id", "fold", "features", "y").withColumn("job", jobs).filter(F.col("fold") != F.expr(f"job div {len(configs)}"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        configs, turns = held.value
        part = part.sort_values("node_id")
        job, target = int(part["job"].iloc[0]), part["target"].iloc[0]
        outer, c = divmod(job, len(configs))
        x, y, fold = frames(part), part["y"].to_numpy(float), part["fold"].to_numpy()
        got, want, status, oob = [], [], "ok", float("nan")
        try:
            for s, inner in enumerate(np.unique(fold)):
                test = fold == inner
                if (~test).sum() < 4 * configs[c].get("least", 3) or test.sum() < 2:
                    continue
                f = VoxelForest(**{**configs[c], "mtry": Mtry(configs[c].get("mtry", "third"))}, turns=turns, seed=seed + c * 100 + s).fit(x[~test], y[~test])
                got.append(f.predict(x[test]))
                want.append(y[test])
                oob = r2(y[~test], f.oob[:, 0])
            score = r2(np.concatenate(want), np.concatenate(got)) if sum(map(len, got)) >= 4 else float("nan")
        except (ValueError, np.linalg.LinAlgError) as e:
            score, status = float("nan"), f"failed: {e}"[:80]
        return pd.DataFrame({"target": [target], "fold": [outer], "config_id": [c], "score": [None if np.isnan(score) else score], "oob": [None if np.isnan(oob) else oob], "status": [status]})

    return rows.groupBy("target", "job").applyInPandas(run, "target string, fold int, config_id int, score double, oob double, status string")


def refit_folds(samples: DataFrame, chosen: DataFrame, configs: Sequence[dict], turns: list[list[int]] | None = None, thresholds: Sequence[float] = (), seed: int = 999) -> DataFrame:
    """The long prediction table of the chosen configuration of each target and fold:
    ``target, fold, node_id, config_id, y_true, y_pred, y_unc, p_above`` (a probability for each
    threshold: the share of trees above it)."""
    held = samples.sparkSession.sparkContext.broadcast((list(configs), turns, list(thresholds)))
    pick = chosen.select(F.col("target").alias("t"), F.col("fold").alias("f"), "config_id")
    rows = samples.select("target", "node_id", "fold", "features", "y").join(F.broadcast(pick), F.col("t") == F.col("target")).drop("t")  # a row per target and fold

    def run(part: pd.DataFrame) -> pd.DataFrame:
        configs, turns, cuts = held.value
        part = part.sort_values("node_id")
        f, c = int(part["f"].iloc[0]), int(part["config_id"].iloc[0])
        test = (part["fold"] == f).to_numpy()
        x, y = frames(part), part["y"].to_numpy(float)
        forest = VoxelForest(**{**configs[c], "mtry": Mtry(configs[c].get("mtry", "third"))}, turns=turns, seed=seed).fit(x[~test], y[~test])
        each = forest.each(x[test])[:, :, 0]
        return pd.DataFrame(
            {"target": part["target"][test], "fold": f, "node_id": part["node_id"][test], "config_id": c, "y_true": y[test], "y_pred": each.mean(0), "y_unc": each.std(0), "p_above": [[float((v > t).mean()) for t in cuts] for v in each.T]}
        )

    return rows.groupBy("target", "f").applyInPandas(run, "target string, fold int, node_id long, config_id int, y_true double, y_pred double, y_unc double, p_above array<double>")


def deploy(nodes: DataFrame, forest: VoxelForest, thresholds: Sequence[float] = ()) -> DataFrame:
    """``node_id, y_pred, y_unc, p_above`` of every node."""
    held = nodes.sparkSession.sparkContext.broadcast((forest, list(thresholds)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, cuts = held.value
        for part in parts:
            each = model.each(frames(part))[:, :, 0] if len(part) else np.zeros((1, 0))
            yield pd.DataFrame({"node_id": part["node_id"], "y_pred": each.mean(0), "y_unc": each.std(0), "p_above": [[float((v > t).mean()) for t in cuts] for v in each.T]})

    return nodes.select("node_id", "features").mapInPandas(run, "node_id long, y_pred double, y_unc double, p_above array<double>")


def zone_of_influence(importance: DataFrame, covariates: int, k: int = 3) -> DataFrame:
    """(channel, a, b, c, importance) of every voxel, from rows (feature, importance)."""
    width = covariates + 1
    voxel = F.expr(f"feature div {width}")
    h = k // 2
    return importance.select(
        (F.col("feature") % width).alias("channel"),
        (F.expr(f"(feature div {width}) div {k * k}") - h).alias("a"),
        (F.expr(f"((feature div {width}) div {k}) % {k}") - h).alias("b"),
        (voxel % k - h).alias("c"),
        "importance",
    )
