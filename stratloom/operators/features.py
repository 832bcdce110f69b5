"""Pattern features: rotations about the vertical, oriented decay statistics, scaling.

What depends on the window only (permutations, weights, axis masks) is computed once on the
driver and enters the plan as literal arrays; patterns are transformed by array functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles
from .grid import cube_offsets


def voxel_rotations(k: int) -> list[list[int]]:
    """For quarter turns 0 to 3 about the vertical: the place in the window that each place takes
    its voxel from."""
    offsets = cube_offsets(k)
    place = {o: x for x, o in enumerate(offsets)}
    out = []
    for turn in range(4):
        row = []
        for a, b, c in offsets:
            for _ in range(turn):
                a, b = b, -a
            row.append(place[a, b, c])
        out.append(row)
    return out


def feature_rotations(k: int, width: int = 5) -> list[list[int]]:
    """The same for flat features with ``width`` values a voxel."""
    return [[v * width + w for v in row for w in range(width)] for row in voxel_rotations(k)]


def rotate(df: DataFrame, features: str, k: int, width: int = 5) -> DataFrame:
    """Every pattern in its four rotations, ``turn`` 0 first."""
    maps = F.array(*(F.array(*(F.lit(v) for v in row)) for row in feature_rotations(k, width)))
    out = df.select("*", F.posexplode(maps).alias("turn", "_m"))
    return out.withColumn(features, F.transform("_m", lambda p: F.get(F.col(features), p))).drop("_m")


def rotation_matrix(azimuth: float, dip: float, tilt: float = 0.0) -> np.ndarray:
    """Rows: unit vectors of the major, semi-major and minor axes.  Azimuth clockwise from north,
    dip downwards, tilt about the major axis; all in degrees."""
    az, dp, tl = np.deg2rad([azimuth, dip, tilt])
    major = np.array([np.sin(az) * np.cos(dp), np.cos(az) * np.cos(dp), -np.sin(dp)])
    ref = np.array([0.0, 0.0, 1.0]) if abs(major[2]) <= 0.99 else np.array([0.0, 1.0, 0.0])  # north for steep dips
    semi = np.cross(ref, major)
    semi /= np.linalg.norm(semi)
    minor = np.cross(major, semi)
    if tilt:
        semi, minor = np.cos(tl) * semi + np.sin(tl) * minor, np.cos(tl) * minor - np.sin(tl) * semi
    return np.stack([major, semi, minor])


def continuity_frame(axes: np.ndarray, ranges: Sequence[float], x: Column, y: Column, z: Column) -> list[Column]:
    """Coordinates along the axes in units of the ranges."""
    return [(x * float(r[0]) + y * float(r[1]) + z * float(r[2])) / float(s) for r, s in zip(axes, ranges, strict=True)]


def decay_pack(k: int, cell: Sequence[float], axes: np.ndarray, ranges: Sequence[float], sharpness: float = 0.5) -> tuple[list[float], list[list[int]]]:
    """For each voxel the weight exp(-sharpness r') at its scaled distance, and for each axis the
    places whose largest component lies on it (the centre and ties go to the earlier axis)."""
    weights, masks = [], [[], [], []]
    for place, o in enumerate(cube_offsets(k)):
        h = axes @ (np.array(o) * np.array(cell))
        weights.append(float(np.exp(-sharpness * np.sqrt(((h / np.array(ranges)) ** 2).sum()))))
        size = np.abs(h)
        masks[0 if size[0] >= max(size[1], size[2]) else 1 if size[1] >= size[2] else 2].append(place)
    return weights, masks


def oriented_stats(df: DataFrame, values: Column, pack: tuple[list[float], list[list[int]]], name: str) -> DataFrame:
    """Adds the weighted mean and variance of the voxel values, and those along each axis: eight
    columns.  ``values`` is an array of doubles in window order.  Means are columns before the
    variances use them, so they are computed once a row."""
    weights, masks = pack
    parts = dict(zip(("all", "major", "semi", "minor"), (list(range(len(weights))), *masks), strict=True))
    total = {p: float(sum(weights[v] for v in places)) for p, places in parts.items()}
    w = {p: F.array(*(F.lit(weights[v]) for v in places)) for p, places in parts.items()}
    df = df.withColumn("_all", values)
    df = df.withColumns({f"_{p}": F.transform(F.array(*(F.lit(v) for v in places)), lambda v: F.get(F.col("_all"), v)) for p, places in parts.items() if p != "all"})
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    df = df.withColumns({f"{name}_{p}_mean": add(F.zip_with(f"_{p}", w[p], lambda a, b: a * b)) / total[p] for p in parts})

    def variance(p: str) -> Column:
        mean = F.col(f"{name}_{p}_mean")
        return add(F.zip_with(f"_{p}", w[p], lambda a, b: (a - mean) * (a - mean) * b)) / total[p]

    return df.withColumns({f"{name}_{p}_var": variance(p) for p in parts}).drop(*(f"_{p}" for p in parts))


def log_standardise(df: DataFrame, cols: Sequence[str], train: Column) -> DataFrame:
    """log1p of the non-negative part, then z-scores with the training rows' mean and population
    deviation (1e-6 at least)."""
    logged = df.withColumns({c: F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in cols})
    own = lambda c: F.when(train, F.col(c))
    stats = logged.agg(*(x for c in cols for x in (F.avg(own(c)).alias(f"_m_{c}"), F.greatest(F.stddev_pop(own(c)), F.lit(1e-6)).alias(f"_s_{c}"))))
    out = logged.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in cols}).drop(*stats.columns)


def impute_median(df: DataFrame, cols: Sequence[str], train: Column) -> DataFrame:
    """Nulls become the exact median of the training rows; NaN in these counts as missing."""
    mids = quantiles(df.filter(train), [], {f"_m_{c}": F.col(c) for c in cols}, [0.5])  # one row
    return df.join(F.broadcast(mids), F.lit(True), "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")[0]) for c in cols}).drop(*mids.columns)


def design(df: DataFrame, base: str, static: Sequence[str], oriented: Sequence[str]) -> DataFrame:
    """Adds ``x``: the (rotated) base features, then static, then oriented ones."""
    rest = [F.col(c).cast("double") for c in (*static, *oriented)]
    return df.withColumn("x", F.concat(F.col(base), F.array(*rest)) if rest else F.col(base))


def feature_names(k: int, covariates: Sequence[str], oriented: Sequence[str] = ()) -> list[str]:
    return [f"{c}@({a},{b},{d})" for a, b, d in cube_offsets(k) for c in (*covariates, "mask")] + list(oriented)


@dataclass(frozen=True)
class Variant:
    """Which parts a pattern design has: rotated copies in training, oriented statistics, window."""

    kernel: int = 3
    rotations: bool = True
    oriented: bool = True

    @property
    def name(self) -> str:
        return f"K{self.kernel}" + "_ROT" * self.rotations + "_ORI" * self.oriented

    def turns(self) -> list[list[int]] | None:
        return feature_rotations(self.kernel) if self.rotations else None
