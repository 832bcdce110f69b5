"""Covariance models, their relations of pairs, generalised least squares trees and kriging."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import settle
from .features import continuity_frame


@dataclass(frozen=True)
class Covariance:
    """(1 - nugget) rho(h) + nugget I + jitter I, with the reduced lag h: the distance after each axis
    is divided by its range.  rho is exp(-h), or (1 + sqrt(3) h) exp(-sqrt(3) h)."""

    axes: tuple[tuple[float, ...], ...]
    ranges: tuple[float, float, float]
    nugget: float = 0.1
    kind: str = "exponential"
    jitter: float = 1e-8

    def rho(self, h):
        if self.kind == "matern32":
            return (1 + np.sqrt(3.0) * h) * np.exp(-np.sqrt(3.0) * h)
        return np.exp(-h)

    def rho_column(self, h: Column) -> Column:
        if self.kind == "matern32":
            return (1 + float(np.sqrt(3.0)) * h) * F.exp(-float(np.sqrt(3.0)) * h)
        return F.exp(-h)

    def scaled(self, at: np.ndarray) -> np.ndarray:
        return at @ np.array(self.axes).T / np.array(self.ranges)

    def matrix(self, at: np.ndarray) -> np.ndarray:
        out = self.cross(at, at)
        out[np.diag_indices(len(at))] += self.nugget + self.jitter
        return out

    def cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Between different supports the nugget scales and is never added."""
        a, b = self.scaled(a), self.scaled(b)
        h = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))
        return (1 - self.nugget) * self.rho(h)

    def whitener(self, at: np.ndarray) -> np.ndarray:
        """Inverse of the Cholesky factor; the jitter grows until the matrix factors."""
        sigma, extra = self.matrix(at), 0.0
        for power in range(-10, 1):
            try:
                return np.linalg.inv(np.linalg.cholesky(sigma + extra * np.eye(len(at))))
            except np.linalg.LinAlgError:
                extra = 10.0**power
        raise np.linalg.LinAlgError("the covariance can't be factored")

    def distance(self, a: str, b: str) -> Column:
        """Scaled distance of two aliased rows with x, y, z."""
        d = [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in "xyz"]
        return F.sqrt(sum((c**2 for c in continuity_frame(np.array(self.axes), self.ranges, *d)), F.lit(0.0)))


BLOCK = 256  # samples in a block
SIDE = 400  # blocks that are broadcast, some 4 MB


def in_blocks(samples: DataFrame, *cols: str) -> DataFrame:
    """The samples as rows (block, s), s an array of about ``BLOCK`` structs of cols, dealt by a hash: what a task
    holds of them at a time."""
    held = settle(samples.select(*cols))
    blocks = max(1, -(-held.count() // BLOCK))
    return settle(held.groupBy(F.pmod(F.xxhash64(*cols), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct(*cols)).alias("s")))


def against_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every row with every block of samples.  The blocks are counted: few are broadcast; of more, each meets the rows in a join by
    block, for which a row is sent once to each block and to no pair."""
    n = blocks.count()
    if n <= SIDE:
        return rows.crossJoin(F.broadcast(blocks))
    names = F.array(*(F.lit(b["block"]) for b in blocks.select("block").collect()))  # numbers of blocks
    return rows.withColumn("block", F.explode(names)).join(blocks, "block")


def _covariance(model: Covariance, s: Column) -> Column:
    d = [F.col(c) - s[c] for c in "xyz"]
    h = F.sqrt(sum((c**2 for c in continuity_frame(np.array(model.axes), model.ranges, *d)), F.lit(0.0)))
    return (1 - model.nugget) * model.rho_column(h)


def covariance_pairs(samples: DataFrame, model: Covariance, key: str = "node_id") -> DataFrame:
    """(a, b, cov) of all pairs of the samples of a kriging system, as its matrix is."""
    met = against_blocks(samples.select(key, "x", "y", "z"), in_blocks(samples, key, "x", "y", "z"))
    pair = met.select(F.col(key).alias("a"), "x", "y", "z", F.explode("s").alias("b"))
    cov = _covariance(model, F.col("b")) + F.when(F.col("a") == F.col(f"b.{key}"), model.nugget + model.jitter).otherwise(0.0)
    return pair.select("a", F.col(f"b.{key}").alias("b"), cov.alias("cov"))


def krige(nodes: DataFrame, samples: DataFrame, model: Covariance, mean: str = "m", alpha: str = "alpha", key: str = "node_id") -> DataFrame:
    """Nodes with ``krig`` = mean + sum of covariance times alpha over the samples of one kriging system.

    A node meets the samples block by block and adds up within a block's array, so pairs are no rows; the sums of
    its blocks are added by node."""
    met = against_blocks(nodes.select(key, "x", "y", "z", F.col(mean).alias("_m")), in_blocks(samples, "x", "y", "z", alpha))
    part = F.aggregate("s", F.lit(0.0), lambda acc, s: acc + F.coalesce(_covariance(model, s) * s[alpha], F.lit(0.0)))
    out = met.withColumn("_c", part).groupBy(key).agg(F.max("_m").alias("_m"), F.sum("_c").alias("_c"))
    return out.select(key, (F.col("_m") + F.col("_c")).alias("krig"))


class GlsTree:
    """A regression tree under correlated errors.  Every split minimises the whitened residual of
    all leaves together, over every distinct cut point by one cumulative sum a feature; leaf values
    are solved jointly.  Rows with x < threshold go left."""

    def __init__(self, depth: int = 4, least: int = 5, mtry: int | None = None, ridge: float = 1e-5):
        self.depth, self.least, self.mtry, self.ridge = depth, least, mtry, ridge

    def fit(self, x: np.ndarray, y: np.ndarray, white: np.ndarray, rng: np.random.Generator) -> "GlsTree":
        n, f = x.shape
        self.feature, self.threshold, self.left, self.right = [-1], [0.0], [-1], [-1]
        leaf = np.zeros(n, np.int64)
        wy = white @ y
        for _ in range(self.depth):
            grown = False
            for node in np.unique(leaf).tolist():
                mine = leaf == node
                if mine.sum() < 2 * self.least:
                    continue
                names = np.unique(leaf)
                basis = white @ (leaf[:, None] == names[None, :]).astype(float)
                q, _ = np.linalg.qr(basis)
                rest = wy - q @ (q.T @ wy)
                best, what = 1e-9, None
                for j in rng.permutation(f)[: self.mtry or f]:
                    rows = np.flatnonzero(mine)[np.argsort(x[mine, j], kind="stable")]
                    v = x[rows, j]
                    # column i is the whitened indicator of the i + 1 smallest rows, free of the leaves
                    c = np.cumsum(white[:, rows], axis=1)
                    c -= q @ (q.T @ c)
                    norm = (c**2).sum(0)
                    at = np.arange(1, len(rows) + 1)
                    ok = (at >= self.least) & (len(rows) - at >= self.least) & (norm > 1e-12)
                    ok[:-1] &= v[:-1] < v[1:]
                    ok[-1] = False
                    gain = np.where(ok, (rest @ c) ** 2 / np.maximum(norm, 1e-12), -1.0)
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, what = gain[i], (int(j), float((v[i] + v[i + 1]) / 2))
                if what is None:
                    continue
                j, t = what
                k = len(self.feature)
                self.feature[node], self.threshold[node], self.left[node], self.right[node] = j, t, k, k + 1
                for column, value in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1)):
                    column.extend([value, value])
                leaf[mine] = np.where(x[mine, j] < t, k, k + 1)
                grown = True
            if not grown:
                break
        names = np.unique(leaf)
        basis = white @ (leaf[:, None] == names[None, :]).astype(float)
        beta = np.linalg.solve(basis.T @ basis + self.ridge * np.eye(len(names)), basis.T @ wy)
        self.value = np.zeros(len(self.feature))
        self.value[names] = beta
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        feature, cut = np.array(self.feature), np.array(self.threshold)
        left, right = np.array(self.left), np.array(self.right)
        at = np.zeros(len(x), np.int64)
        for _ in range(len(feature)):
            inner = feature[at] >= 0
            if not inner.any():
                break
            rows = np.flatnonzero(inner)
            a = at[rows]
            at[rows] = np.where(x[rows, feature[a]] < cut[a], left[a], right[a])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.apply(x)]


class GlsForest:
    """Trees on resampled whitened contrasts; out-of-bag means; kriging of their residuals."""

    def __init__(self, model: Covariance, trees: int = 20, depth: int = 4, least: int = 5, mtry: int | None = None, seed: int = 42):
        self.model, self.n, self.depth, self.least, self.mtry, self.seed = model, trees, depth, least, mtry, seed

    def fit(self, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> "GlsForest":
        self.at, n = at, len(y)
        white = self.model.whitener(at)
        self.centre = float(y.mean())
        yc = y - self.centre
        self.trees, total, seen = [], np.zeros(n), np.zeros(n)
        for t in range(self.n):
            rng = np.random.default_rng(self.seed + t)
            rows = rng.integers(0, n, n)
            tree = GlsTree(self.depth, self.least, self.mtry).fit(x, yc, white[rows], rng)
            self.trees.append(tree)
            out = np.setdiff1d(np.arange(n), rows)
            total[out] += tree.predict(x[out])
            seen[out] += 1
        self.oob = total / np.maximum(seen, 1) + self.centre
        if (seen == 0).any():  # drawn by every tree: the forest's own prediction
            self.oob[seen == 0] = self.predict(x[seen == 0])
        self.alpha = white.T @ (white @ (y - self.oob))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], 0) + self.centre

    def krige(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.predict(x) + self.model.cross(at, self.at) @ self.alpha


def gls_folds(samples: DataFrame, features: list[str], y: str, folds: int, model: Covariance, **options) -> DataFrame:
    """(node_id, fold, y_true, y_pred, y_krig): one forest per fold, each a task; the samples of a
    fold's training are the few hundred rows of one covariance matrix."""
    cols = ["node_id", "x", "y", "z", "fold", *features, y]
    rows = samples.select(*(F.col(c) for c in dict.fromkeys(cols))).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node_id")
        test = (part["fold"] == part["task"]).to_numpy()
        x, at, t = part[features].to_numpy(float), part[["x", "y", "z"]].to_numpy(float), part[y].to_numpy(float)
        if not test.any() or (~test).sum() < 10:
            return pd.DataFrame({"node_id": [], "fold": [], "y_true": [], "y_pred": [], "y_krig": []})
        forest = GlsForest(model, **options).fit(x[~test], t[~test], at[~test])
        return pd.DataFrame({"node_id": part["node_id"][test], "fold": part["fold"][test], "y_true": t[test], "y_pred": forest.predict(x[test]), "y_krig": forest.krige(x[test], at[test])})

    return rows.groupBy("task").applyInPandas(run, "node_id long, fold int, y_true double, y_pred double, y_krig double")


def deploy_gls(nodes: DataFrame, forest: GlsForest, features: list[str]) -> DataFrame:
    """Mean and kriged predictions of all nodes, batch by batch."""
    held = nodes.sparkSession.sparkContext.broadcast(forest)  # trees and one system's samples

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x, at = part[features].to_numpy(float), part[["x", "y", "z"]].to_numpy(float)
            yield pd.DataFrame({"node_id": part["node_id"], "y_pred": held.value.predict(x), "y_krig": held.value.krige(x, at)})

    return nodes.select("node_id", "x", "y", "z", *features).mapInPandas(run, "node_id long, y_pred double, y_krig double")
