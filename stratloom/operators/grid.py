"""Grid operators: indexing of coordinates, stencils over a sparse lattice, window patterns.

A grid is a DataFrame with one row per cell, keyed by integer indices ``i, j, k``; cells
that don't exist have no row.  Stencils that aggregate scatter: every cell sends its values to the
cells around it and one aggregation, with partial sums before the exchange, gathers them.  The
offsets are a literal array of structs, so no join and no densified box is needed.  Windows, which
keep every voxel and so have no partial sums, are read off tiles with a halo.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.scalars import nan_to_null

Offset = tuple[int, int, int]


def cube_offsets(k: int = 3, centre: bool = True) -> list[Offset]:
    """Offsets of a k x k x k window, in the order i, j, k."""
    h = k // 2
    return [(a, b, c) for a in range(-h, h + 1) for b in range(-h, h + 1) for c in range(-h, h + 1) if centre or (a, b, c) != (0, 0, 0)]


def face_offsets() -> list[Offset]:
    return [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def missing_to_null(df: DataFrame, cols: Sequence[str], tokens: Sequence[str] = ("", "-", "nan", "na", "null", "none")) -> DataFrame:
    """Strings to doubles; missing tokens, NaN and what isn't a number become null."""

    def one(c: str) -> Column:
        v = F.trim(F.col(c).cast("string"))
        return nan_to_null(F.when(~F.lower(v).isin(*tokens), v).try_cast("double"))

    return df.withColumns({c: one(c) for c in cols})


def parse_ijk(df: DataFrame, col: str = "ijk") -> DataFrame:
    """Adds ``pi, pj, pk`` from texts such as 1_2_3: the first of ``_ - , ;`` or white space that
    occurs separates; anything but three integers is null.  If all rows parse, ``i0, j0, k0``
    count from the least index, else they are null."""
    text = F.trim(F.col(col))
    sep = F.when(text.contains("_"), "_").when(text.contains("-"), "-").when(text.contains(","), ",").when(text.contains(";"), ";").otherwise(" ")
    parts = F.filter(F.transform(F.split(F.translate(text, "\t", " "), F.concat(F.lit("\\Q"), sep, F.lit("\\E"))), lambda p: F.trim(p)), lambda p: p != "")
    numbers = F.transform(parts, lambda p: p.try_cast("int"))
    good = (F.size(parts) == 3) & F.forall(numbers, lambda x: x.isNotNull())
    df = df.withColumn("_n", F.when(good, numbers))
    out = df.withColumns({c: F.col("_n")[x] for x, c in enumerate(("pi", "pj", "pk"))}).drop("_n")
    least = out.agg(F.bool_and(F.col("pi").isNotNull()).alias("_all"), *(F.min(c).alias(f"_{c}") for c in ("pi", "pj", "pk")))
    out = out.crossJoin(F.broadcast(least))  # one row
    return out.withColumns({f"{c[1]}0": F.when(F.col("_all"), F.col(c) - F.col(f"_{c}")) for c in ("pi", "pj", "pk")}).drop("_all", "_pi", "_pj", "_pk")


def index_axis(df: DataFrame, coord: str, out: str, digits: int | None = None) -> DataFrame:
    """Adds the place of a coordinate among its distinct (rounded) values, from 0.  Only the
    distinct values, as many as the grid has planes, are ranked; they are joined back."""
    value = F.round(F.col(coord), digits) if digits is not None else F.col(coord)
    df = df.withColumn("_v", value)
    planes = df.select("_v").distinct().withColumn(out, F.row_number().over(W.orderBy("_v")) - 1)
    return df.join(planes, "_v", "left").drop("_v")


def unique_cells(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ("i", "j", "k")) -> DataFrame:
    """One row per cell: of several the last in the given order; ``n_rows`` tells how many there were."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("_x"), F.count("*").alias("n_rows")).select(*keys, "_x.*", "n_rows")


def scatter(df: DataFrame, offsets: Sequence[Offset], values: dict[str, Column], index: str | None = None) -> DataFrame:
    """Every cell once per offset, under the key of the cell that sees it there.  ``index`` names
    a column with the place of the offset (as the receiving cell counts it)."""
    # the receiver at (i - a) sees this cell at offset a
    laid = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("a", "b", "c", "o"), (*o, x), strict=True))) for x, o in enumerate(offsets)))
    out = df.select("i", "j", "k", *(c.alias(n) for n, c in values.items()), F.explode(laid).alias("_o"))
    keys = [(F.col(n) - F.col(f"_o.{m}")).alias(n) for n, m in zip(("i", "j", "k"), ("a", "b", "c"), strict=True)]
    extra = [F.col("_o.o").alias(index)] if index else []
    centre = ((F.col("_o.a") == 0) & (F.col("_o.b") == 0) & (F.col("_o.c") == 0)).alias("centre")
    return out.select(*keys, centre, *values, *extra)


def neighbourhood(df: DataFrame, value: str, offsets: Sequence[Offset], aggs: dict[str, Column]) -> DataFrame:
    """For every cell its own ``value`` and aggregates over its neighbours, in which ``v`` is a
    neighbour's value (null for the cell itself) and ``own`` the cell's."""
    sent = scatter(df.filter(F.col(value).isNotNull()), [(0, 0, 0), *offsets], {"v": F.col(value)})
    sent = sent.withColumns({"own": F.when(F.col("centre"), F.col("v")), "v": F.when(~F.col("centre"), F.col("v"))})
    return sent.groupBy("i", "j", "k").agg(F.max("own").alias("own"), *(c.alias(n) for n, c in aggs.items())).filter("own is not null")


def halo(df: DataFrame, tile: int, reach: int) -> DataFrame:
    """Every cell once for each tile of ``tile`` ** 3 cells that it lies in or within ``reach`` of, as
    (ti, tj, tk) and the columns of df: (1 + 2 * reach / tile) ** 3 times on average."""
    low, high = (lambda a: F.floor((F.col(a) - reach) / tile)), (lambda a: F.floor((F.col(a) + reach) / tile))
    out = df
    for a in "ijk":
        out = out.withColumn(f"t{a}", F.explode(F.sequence(low(a), high(a))))
    return out


def window_patterns(df: DataFrame, covariates: Sequence[str], dims: tuple[int, int, int], k: int = 3, tile: int = 16) -> DataFrame:
    """Gathers k x k x k windows around every cell that is k // 2 or more inside of the box.

    Columns: ``n_present, n_valid`` (all covariates there) and ``vox``, an array over the voxels
    that exist, ordered by place, of structs (o, valid, covariates).

    Cells are dealt to tiles with a halo of k // 2 and windows are read off the tile, a dense box of
    bounded size, so a cell travels less than twice where a tile is eight halos wide.  Places of the
    lattice without a cell have no window of their own unless a voxel of it exists; a null
    covariate makes its voxel invalid; cells are unique (``unique_cells``)."""
    h, names = k // 2, list(covariates)
    width, offsets = tile + 2 * h, np.array(cube_offsets(k)) + h
    voxel = T.StructType([T.StructField("o", T.IntegerType()), T.StructField("valid", T.BooleanType()), *(T.StructField(c, T.DoubleType()) for c in names)])
    schema = T.StructType([*(T.StructField(a, T.IntegerType()) for a in "ijk"), T.StructField("n_present", T.LongType()), T.StructField("n_valid", T.LongType()), T.StructField("vox", T.ArrayType(voxel))])
    valid = F.lit(True)
    for c in names:
        valid = valid & F.col(c).isNotNull()

    def run(key: tuple, part: pa.Table) -> pa.Table:
        corner = np.array([x.as_py() for x in key]) * tile
        at = np.stack([part[a].to_numpy() for a in "ijk"], 1) - corner + h
        row = np.full((width, width, width), -1, np.int64)
        row[tuple(at.T)] = np.arange(len(at))
        inner = np.stack(np.meshgrid(*[np.arange(tile)] * 3, indexing="ij"), -1).reshape(-1, 3)
        whole = inner + corner
        inner = inner[((whole >= h) & (whole <= np.array(dims) - 1 - h)).all(1)]
        seen = row[tuple(np.moveaxis(inner[:, None, :] + offsets[None], -1, 0))]  # windows by places
        some = (seen >= 0).any(1)
        inner, seen = inner[some], seen[some]
        there = seen >= 0
        good = part["valid"].to_numpy()
        own = seen[there]
        counts = there.sum(1)
        fields = [pa.array(np.broadcast_to(np.arange(k**3, dtype=np.int32), seen.shape)[there]), pa.array(good[own]), *(part[c].combine_chunks().take(pa.array(own)) for c in names)]
        ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
        vox = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, ["o", "valid", *names]))
        n_valid = (there & good[seen]).sum(1) if len(good) else counts
        places = (inner + corner).astype(np.int32)
        return pa.table([*(pa.array(places[:, x]) for x in range(3)), pa.array(counts.astype(np.int64)), pa.array(n_valid.astype(np.int64)), vox], names=["i", "j", "k", "n_present", "n_valid", "vox"])

    cells = df.select(*(F.col(a).cast("int").alias(a) for a in "ijk"), valid.alias("valid"), *(F.col(c).cast("double").alias(c) for c in names))
    return halo(cells, tile, h).groupBy("ti", "tj", "tk").applyInArrow(run, schema)


def accepted(patterns: DataFrame, k: int = 3, coverage: float = 0.70) -> DataFrame:
    """Windows with enough valid voxels; voxels that don't exist count as invalid."""
    return patterns.filter(F.col("n_valid") / float(k**3) >= coverage)


def idw_weights(k: int, cell: tuple[float, float, float], power: float = 2.0, eps: float = 1e-8) -> list[list[float]]:
    """Weights of every voxel of the window for every other, by physical distance."""
    offsets = cube_offsets(k)
    out = []
    for a in offsets:
        row = []
        for b in offsets:
            d = sum(((x - y) * s) ** 2 for x, y, s in zip(a, b, cell, strict=True)) ** 0.5
            row.append((d + eps) ** -power)
        out.append(row)
    return out


def fill_idw(patterns: DataFrame, covariates: Sequence[str], k: int, cell: tuple[float, float, float]) -> DataFrame:
    """Adds ``filled``: for each of the k ** 3 voxels a struct (o, missing, covariates), those of
    missing voxels interpolated from the valid ones of the window by inverse distance.

    A window is a product with the k ** 3 by k ** 3 weights, which array functions would evaluate
    pair by pair without generated code; so this runs over Arrow batches."""
    weights = np.array(idw_weights(k, cell))
    names, size = list(covariates), k**3
    voxel = T.StructType([T.StructField("o", T.IntegerType()), T.StructField("missing", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in names)])
    schema = T.StructType([*patterns.schema.fields, T.StructField("filled", T.ArrayType(voxel))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vox = batch.column(batch.schema.get_field_index("vox"))
            n, inner = len(batch), vox.flatten()
            row = np.repeat(np.arange(n), np.diff(vox.offsets.to_numpy()))
            place, good = inner.field("o").to_numpy(), inner.field("valid").to_numpy(zero_copy_only=False)
            row, place = row[good], place[good]
            there = np.zeros((n, size))
            there[row, place] = 1
            total = np.maximum(there @ weights.T, 1e-12)
            cols = []
            for c in names:
                own = np.zeros((n, size))
                own[row, place] = inner.field(c).to_numpy(zero_copy_only=False)[good]
                cols.append(pa.array(np.where(there == 1, own, own @ weights.T / total).ravel()))
            parts = [pa.array(np.tile(np.arange(size, dtype=np.int32), n)), pa.array((there == 0).ravel().astype(np.int32)), *cols]
            ends = pa.array(np.arange(0, n * size + 1, size, dtype=np.int32))
            filled = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, ["o", "missing", *names]))
            yield pa.RecordBatch.from_arrays([*batch.columns, filled], [*batch.schema.names, "filled"])

    return patterns.mapInArrow(run, schema)


def flatten_patterns(filled: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """Adds ``features``: voxel after voxel the covariates and the mask (1 = was missing)."""
    return filled.withColumn("features", F.flatten(F.transform("filled", lambda v: F.array(*(v[c] for c in covariates), v["missing"].cast("double")))))


def layout_ok(df: DataFrame, width: int = 5) -> Column:
    """Whether every ``width``-th feature is a mask value."""
    masks = F.filter(F.transform("features", lambda x, p: F.when(p % width == width - 1, x)), lambda x: x.isNotNull())
    return F.forall(masks, lambda x: x.isin(0.0, 1.0))
