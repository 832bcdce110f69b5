"""Second-order boosting with a regularised objective, for node tables of a few hundred rows.

Squared loss; leaves and gains carry an L2 weight, children need a least sum of weights,
trees see samples of rows and columns.  Folds are tasks; a fit is numpy.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forest import Tree


@dataclass
class Boosted:
    rounds: int = 100
    rate: float = 0.1
    depth: int = 4
    l2: float = 1.0
    child: float = 1.0
    rows: float = 0.8
    columns: float = 0.8
    gamma: float = 0.0
    bins: int = 64
    seed: int = 42

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        rng = np.random.default_rng(self.seed)
        n, f = x.shape
        self.base = float(y.mean())
        raw = np.full(n, self.base)
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        self.trees: list[Tree] = []
        for _ in range(self.rounds):
            mine = rng.choice(n, max(1, int(self.rows * n)), replace=False)
            cols = rng.choice(f, max(1, int(self.columns * f)), replace=False)
            g = raw[mine] - y[mine]
            feature, cut, left, right, value = [-1], [0.0], [-1], [-1], [0.0]
            todo = [(0, np.arange(len(mine)), 0)]
            while todo:
                node, at, level = todo.pop()
                gs, hs = g[at].sum(), float(len(at))
                value[node] = -self.rate * gs / (hs + self.l2)
                if level == self.depth or hs < 2 * self.child:
                    continue
                best = (self.gamma, -1, 0)
                for j in cols:
                    k = len(edges[j])
                    if not k:
                        continue
                    own = code[mine[at], j]
                    lg, lh = np.bincount(own, g[at], k + 1).cumsum()[:-1], np.bincount(own, minlength=k + 1).cumsum()[:-1]
                    gain = 0.5 * (lg**2 / (lh + self.l2) + (gs - lg) ** 2 / (hs - lh + self.l2) - gs**2 / (hs + self.l2))
                    gain[(lh < self.child) | (hs - lh < self.child)] = -np.inf
                    b = int(gain.argmax())
                    if gain[b] > best[0]:
                        best = (float(gain[b]), int(j), b)
                if best[1] < 0:
                    continue
                side = code[mine[at], best[1]] <= best[2]
                k = len(feature)
                feature[node], cut[node], left[node], right[node] = best[1], float(edges[best[1]][best[2]]), k, k + 1
                for column, v in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (value, 0.0)):
                    column += [v, v]
                todo += [(k, at[side], level + 1), (k + 1, at[~side], level + 1)]
            tree = Tree(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value)[:, None])
            self.trees.append(tree)
            raw += tree.predict(x)[:, 0]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(t.predict(x)[:, 0] for t in self.trees)


def predict_folds(samples: DataFrame, features: Sequence[str], folds: int, **options) -> DataFrame:
    """(node_id, fold, y_true, y_pred): each fold predicted by a model of the others; missing
    values take the training rows' median."""
    rows = samples.select("node_id", "fold", "y", *features).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node_id")
        test = (part["fold"] == part["task"]).to_numpy()
        x = part[list(features)].to_numpy(float)
        x = np.where(np.isnan(x), np.nanmedian(x[~test], 0), x)
        y = part["y"].to_numpy(float)
        p = Boosted(**options).fit(x[~test], y[~test]).predict(x[test])
        return pd.DataFrame({"node_id": part["node_id"][test], "fold": part["fold"][test], "y_true": y[test], "y_pred": p})

    return rows.groupBy("task").applyInPandas(run, "node_id long, fold int, y_true double, y_pred double")
