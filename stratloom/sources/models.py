"""Fitted forests as tables: one row per tree, nodes as arrays of structs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.forest import Mtry, Tree, VoxelForest

SCHEMA = "model string, tree int, classes int, depth int, least int, mtry string, seed int, turns array<array<int>>, nodes array<struct<feature:int, threshold:double, left:int, right:int, value:array<double>>>"


def to_table(spark: SparkSession, name: str, forest: VoxelForest) -> DataFrame:
    turns = [list(map(int, t)) for t in forest.turns] if forest.turns else None
    rows = [
        (name, t, forest.classes, forest.depth, forest.least, str(forest.mtry.value), forest.seed, turns, [(int(f), float(c), int(a), int(b), [float(x) for x in v]) for f, c, a, b, v in zip(tree.feature, tree.threshold, tree.left, tree.right, tree.value, strict=True)])
        for t, tree in enumerate(forest.trees)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def from_table(table: DataFrame, name: str) -> VoxelForest:
    """The forest of that name; a forest has some dozens of trees."""
    rows = table.filter(table.model == name).orderBy("tree").collect()
    if not rows:
        raise KeyError(name)
    first = rows[0]
    out = VoxelForest(trees_n=len(rows), depth=first.depth, least=first.least, mtry=Mtry.parse(first.mtry), seed=first.seed, classes=first.classes, turns=first.turns)
    column = lambda r, c: np.array([n[c] for n in r.nodes])
    out.trees = [Tree(column(r, "feature"), column(r, "threshold"), column(r, "left"), column(r, "right"), column(r, "value")) for r in rows]
    return out


def save(spark: SparkSession, path: str, forests: dict[str, VoxelForest]) -> None:
    names: Sequence[str] = list(forests)
    table = to_table(spark, names[0], forests[names[0]])
    for n in names[1:]:
        table = table.unionByName(to_table(spark, n, forests[n]))
    table.write.mode("overwrite").parquet(path)
