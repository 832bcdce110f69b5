"""Coherence of fields on the lattice: spikes, discordance, class support, connectivity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import digitize
from .grid import Offset, cube_offsets, face_offsets, scatter
from .lineage import settle

ALL = cube_offsets(3, centre=False)


def with_neighbours(field: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """For every cell of every field (keys, i, j, k, v): its value ``own`` and aggregates over the
    values ``w`` of its up to 26 neighbours."""
    sent = scatter_fields(field, keys, [(0, 0, 0), *ALL])
    sent = sent.withColumns({"own": F.when(F.col("centre"), F.col("v")), "w": F.when(~F.col("centre"), F.col("v"))})
    return sent.groupBy(*keys, "i", "j", "k").agg(F.max("own").alias("own"), F.count("w").alias("n_near"), *(c.alias(n) for n, c in aggs.items())).filter("own is not null")


def scatter_fields(field: DataFrame, keys: Sequence[str], offsets: Sequence[Offset]) -> DataFrame:
    return scatter(field.filter("v is not null"), offsets, {**{c: F.col(c) for c in keys}, "v": F.col("v")})


def spikes(field: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spike index z = (v - median of the neighbours) / sd of the field, for cells with neighbours:
    mean |z| (roughness) and the percentages beyond 2 and 3."""
    sd = field.groupBy(*keys).agg(F.stddev_pop("v").alias("sd"))
    cells = with_neighbours(field, keys, {"mid": F.median("w")}).filter("n_near > 0").join(F.broadcast(sd), list(keys))
    z = F.abs((F.col("own") - F.col("mid")) / F.col("sd"))
    return cells.groupBy(*keys).agg(F.count("*").alias("n_cells"), F.avg(z).alias("roughness"), (100 * F.avg((z > 2).cast("double"))).alias("spike2_pct"), (100 * F.avg((z > 3).cast("double"))).alias("spike3_pct"))


def discordance(field: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percentage of cells beyond one deviation whose neighbours' mean lies on the other side."""
    stat = field.groupBy(*keys).agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    cells = with_neighbours(field, keys, {"near": F.avg("w")}).filter("n_near > 0").join(F.broadcast(stat), list(keys))
    z, zn = (F.col("own") - F.col("mu")) / F.col("sd"), (F.col("near") - F.col("mu")) / F.col("sd")
    return cells.groupBy(*keys).agg(F.count("*").alias("n_cells"), (100 * F.avg(((F.signum(z) != F.signum(zn)) & (F.abs(z) > 1)).cast("double"))).alias("discordant_pct"))


def classes(v: Column, cuts: Sequence[Column]) -> Column:
    """Number of cuts at or below the value: right-open classes."""
    return digitize(v, cuts)


def class_support(field: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For every cell of a field of classes: cells of its class among its 27 (itself included) and
    its modelled neighbours."""
    own = with_neighbours(field, keys, {"near": F.collect_list("w")})  # 26 at most
    same = F.size(F.filter("near", lambda w: w == F.col("own")))
    return own.select(*keys, "i", "j", "k", F.col("own").alias("class"), (same + 1).alias("support"), "n_near")


def specks(support: DataFrame, keys: Sequence[str], least: int = 5, floor: int = 8) -> DataFrame:
    """Speck percentages: cells with less than ``least`` support among those with ``floor``
    neighbours, and among those with all 26; bands of support and its median."""
    ok, full = F.col("n_near") >= floor, F.col("n_near") == 26
    speck = F.col("support") < least
    share = lambda what, base: 100.0 * F.count_if(what & base) / F.count_if(base)
    return support.groupBy(*keys).agg(
        F.count_if(ok).alias("n_tested"),
        share(speck, ok).alias("speck_pct"),
        F.when(F.count_if(full) > 0, share(speck, full)).alias("speck_full_pct"),
        share(F.col("support") <= 4, ok).alias("band_1_4"),
        share(F.col("support").between(5, 13), ok).alias("band_5_13"),
        share(F.col("support") >= 14, ok).alias("band_14_27"),
        F.median(F.when(ok, F.col("support"))).alias("median_support"),
    )


def levels_of(v: Column, cuts: Sequence[Column]) -> Column:
    """The number of cut-offs at or below the value; cut-offs rise."""
    return digitize(v, cuts).cast("int")


def _local_tree(part: np.ndarray, level: np.ndarray, offsets: Sequence[Offset], top: int) -> list[np.ndarray]:
    """For each level from 1 to ``top`` the component of every cell, as the place of one of its cells, or -1 below
    the level.  Levels fall: an edge is used once, at the lower level of its ends, and joins what
    the levels above have joined."""
    n = len(part)
    base = part - part.min(0) + 1
    dims = base.max(0) + 2
    code = (base[:, 0] * dims[1] + base[:, 1]) * dims[2] + base[:, 2]
    order = np.argsort(code)
    table = code[order]
    pairs = []
    for a, b, c in offsets:
        step = (a * dims[1] + b) * dims[2] + c
        if step > 0:  # every pair is met from one side
            at = np.minimum(np.searchsorted(table, code + step), n - 1)
            hit = table[at] == code + step
            pairs.append(np.stack([np.flatnonzero(hit), order[at[hit]]]))
    pairs = np.concatenate(pairs, 1)
    low = np.minimum(level[pairs[0]], level[pairs[1]])
    label, out = np.arange(n), []
    for now in range(top, 0, -1):
        edges = label[pairs[:, low == now]]
        while True:  # least label over the edges, with pointer jumping
            new = label.copy()
            np.minimum.at(new, edges[0], label[edges[1]])
            np.minimum.at(new, edges[1], label[edges[0]])
            new = new[new]
            if (new == label).all():
                break
            label = new
        root = label
        while (root[root] != root).any():
            root = root[root]
        label = root
        out.append(np.where(level >= now, label, -1))
    return out[::-1]


def component_tree(cells: DataFrame, keys: Sequence[str], top: int, connect: int = 6, tile: int = 32) -> DataFrame:
    """The tree of components over all cut-offs: (keys, level, component, size, parent) from cells
    (keys, i, j, k, level), where ``level`` says how many of the ``top`` rising cut-offs a cell reaches.

    A component of a level is named by its least cell, i:j:k with digits to the same width; its parent is
    the component of the level below that holds it, null at level 1.  Every question about a
    cut-off (sizes, counts, shares) is read off the rows of its level.

    Each tile of ``tile`` ** 3 cells makes its part of the tree in one falling pass in a task of its own.  Only
    components that reach a face of their tile meet others, at the lower level of two cells that
    touch, and the graph of these, far smaller than the field, is solved by rounds of stars for
    all levels together.  Cells at level 0 and fields without others give no rows."""
    keys = list(keys)
    offsets = face_offsets() if connect == 6 else ALL
    tiles = [F.floor(F.col(a) / tile).alias(f"t{a}") for a in "ijk"]
    typed = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in keys)

    def local(part: pd.DataFrame) -> pd.DataFrame:
        at, level = part[["i", "j", "k"]].to_numpy(np.int64), part["level"].to_numpy(np.int64)
        order = np.lexsort((at[:, 2], at[:, 1], at[:, 0]))  # so that the least label is the least cell
        part, at, level = part.iloc[order], at[order], level[order]
        names = np.array([f"{a:010d}:{b:010d}:{c:010d}" for a, b, c in at + (1 << 30)], dtype=object)
        rim = ((at % tile == 0) | (at % tile == tile - 1)).any(1)
        out, below = [], None
        for now, label in enumerate(_local_tree(at, level, offsets, top), 1):
            mine = np.flatnonzero(label >= 0)
            roots, size = np.unique(label[mine], return_counts=True)
            frame = pd.DataFrame({"level": now, "label": names[roots], "size": size, "parent": names[below[roots]] if below is not None else None, "i": None, "j": None, "k": None})
            edge = mine[rim[mine]]
            face = pd.DataFrame({"level": now, "label": names[label[edge]], "size": 0, "parent": None, "i": at[edge, 0], "j": at[edge, 1], "k": at[edge, 2]})
            out += [frame, face]
            below = label
        out = pd.concat([f.astype(object) for f in out], ignore_index=True)
        for c in reversed(keys):
            out.insert(0, c, part[c].iloc[0])
        return out

    parts = settle(cells.filter("level > 0").select(*keys, "i", "j", "k", "level", *tiles).groupBy(*keys, "ti", "tj", "tk").applyInPandas(local, f"{typed}, level int, label string, size long, parent string, i int, j int, k int"))
    nodes = parts.filter("i is null").select(*keys, "level", "label", "size", "parent")
    rim = parts.filter("i is not null").select(*keys, "level", "label", "i", "j", "k")
    sent = scatter(rim, offsets, {**{c: F.col(c) for c in (*keys, "level")}, "label": F.col("label")}).withColumnRenamed("label", "other")
    edges = sent.join(rim, [*keys, "level", "i", "j", "k"]).filter("label <> other").select(*keys, "level", F.greatest("label", "other").alias("a"), F.least("label", "other").alias("b")).distinct()
    named = stars(edges, [*keys, "level"])
    if named is None:
        return nodes.select(*keys, "level", F.col("label").alias("component"), "size", "parent")
    by = [*keys, "level"]
    joined = nodes.join(named.withColumnRenamed("a", "label"), [*by, "label"], "left").withColumn("component", F.coalesce("b", "label")).drop("b")
    up = named.select(*keys, (F.col("level") + 1).alias("level"), F.col("a").alias("parent"), F.col("b").alias("_p"))
    return joined.join(up, [*by, "parent"], "left").groupBy(*by, "component").agg(F.sum("size").alias("size"), F.min(F.coalesce("_p", "parent")).alias("parent"))


def connectivity(cells: DataFrame, keys: Sequence[str], connect: int = 6, tile: int = 32) -> DataFrame:
    """(keys, component, size) of cells that all count: a tree of one level."""
    return component_tree(cells.withColumn("level", F.lit(1)), keys, 1, connect, tile).select(*keys, "component", "size")


def stars(edges: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """(keys, a, b): for every node of the graph with edges (keys, a, b) the least node b that it
    reaches, nodes that are least themselves left out; None without edges."""
    keys = list(keys)
    now, seen = settle(edges), None
    if now.isEmpty():
        return None
    while True:
        both = now.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(*keys, "b", "a"))
        least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [*keys, "u"]).filter("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        now = settle(small.select(*keys, F.col("u").alias("a"), F.col("v").alias("b")).distinct())
        mark = now.agg(F.count("*"), F.expr(f"bit_xor(xxhash64({', '.join([*keys, 'a', 'b'])}))")).first()
        if mark == seen:
            return now
        seen = mark


def connectivity_stats(sizes: DataFrame, keys: Sequence[str], viable: int = 12) -> DataFrame:
    s = F.col("size")
    return sizes.groupBy(*keys).agg(
        F.sum(s).alias("n_above"),
        F.count("*").alias("n_components"),
        F.count_if(s >= viable).alias("n_viable"),
        F.max(s).alias("largest"),
        (F.max(s) / F.sum(s)).alias("largest_frac"),
        F.count_if(s == 1).alias("singletons"),
        (F.sum(F.when(s < viable, s).otherwise(0)) / F.sum(s)).alias("frac_in_small"),
        F.median(s).alias("median_size"),
    )
