"""Queries over the lattice view, each with the DuckDB text of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ERFC
from ..operators import coherence, features, folds, grid, joins, kriging, metrics, reports
from ..operators.lineage import settle
from ..operators.quantiles import quantiles
from ..sources import readers
from . import lattice as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

COV = L.COVARIATES
METHODS = ("BLK", "COL", "NBR")
KEYS = ("target", "method")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def with_(prefix: str, text: str) -> str:
    return f"WITH {prefix} {text}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


# --- scans and indexing ---------------------------------------------------------------------


@query(
    """WITH t AS (SELECT l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN '-' WHEN 1 THEN 'NaN' WHEN 2 THEN ' ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' ' ELSE CASE WHEN l_quantity > 25 THEN 'abc' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.5' END END AS v FROM lineitem),
    n AS (SELECT l_linenumber, CASE WHEN lower(trim(v)) IN ('', '-', 'nan', 'na', 'null', 'none') THEN NULL ELSE TRY_CAST(trim(v) AS DOUBLE) END AS d FROM t)
    SELECT l_linenumber, count(*) AS n, count(d) AS n_number, round(sum(d), 6) AS total FROM n GROUP BY 1"""
)
def missing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int").cast("string")
    text = F.when(F.col("l_linenumber") % 4 == 0, "-").when(F.col("l_linenumber") % 4 == 1, "NaN").when(F.col("l_linenumber") % 4 == 2, F.concat(F.lit(" "), q, F.lit(" "))).otherwise(F.when(F.col("l_quantity") > 25, "abc").otherwise(F.concat(q, F.lit(".5"))))
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", text.alias("d"))
    return rounded(grid.missing_to_null(t, ["d"]).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count("d").alias("n_number"), F.sum("d").alias("total")))


@query(with_(L.CELLS, "SELECT node_id, dense_rank() OVER (ORDER BY x) - 1 AS ix, dense_rank() OVER (ORDER BY y) - 1 AS iy, dense_rank() OVER (ORDER BY z) - 1 AS iz, n, round(fe, 6) AS fe FROM cells"))
def lattice_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = L.cells(spark, sf_dir)
    for axis in "xyz":
        c = grid.index_axis(c, axis, f"i{axis}")
    return rounded(c.select("node_id", *(F.col(f"i{a}").cast("long").alias(f"i{a}") for a in "xyz"), "n", "fe"))


@query(with_(L.CELLS, "SELECT node_id, dense_rank() OVER (ORDER BY round(x + 0.0001 * (j % 3), 3)) - 1 AS ix, dense_rank() OVER (ORDER BY round(z + 0.0002 * (i % 2), 3)) - 1 AS iz FROM cells"))
def rounded_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = L.cells(spark, sf_dir).withColumns({"x": F.col("x") + 0.0001 * (F.col("j") % 3), "z": F.col("z") + 0.0002 * (F.col("i") % 2)})
    c = grid.index_axis(grid.index_axis(c, "x", "ix", 3), "z", "iz", 3)
    return c.select("node_id", F.col("ix").cast("long").alias("ix"), F.col("iz").cast("long").alias("iz"))


_IJK = """,
texts AS (SELECT node_id, CASE node_id % 6 WHEN 0 THEN i || '_' || j || '_' || k WHEN 1 THEN i || '-' || j || '-' || k WHEN 2 THEN i || ', ' || j || ',' || k WHEN 3 THEN i || '_' || j WHEN 4 THEN i || ' ' || j || '  ' || k ELSE 'x;' || j || ';' || k END AS t FROM cells),
cut AS (SELECT node_id, list_transform(list_filter(list_transform(string_split(t, CASE WHEN contains(t, '_') THEN '_' WHEN contains(t, '-') THEN '-' WHEN contains(t, ',') THEN ',' WHEN contains(t, ';') THEN ';' ELSE ' ' END), lambda p: trim(p)), lambda p: p <> ''), lambda p: TRY_CAST(p AS INT)) AS v FROM texts),
ok AS (SELECT node_id, CASE WHEN len(v) = 3 AND list_count(v) = 3 THEN v END AS v FROM cut)
"""


@query(with_(L.CELLS + _IJK, "SELECT node_id, v[1] AS pi, v[2] AS pj, v[3] AS pk, CAST(NULL AS INT) AS i0, CAST(NULL AS INT) AS j0, CAST(NULL AS INT) AS k0 FROM ok"))
def ijk_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda sep, *cols: F.concat_ws(sep, *(F.col(c).cast("string") for c in cols))
    m = F.col("node_id") % 6
    text = F.when(m == 0, s("_", "i", "j", "k")).when(m == 1, s("-", "i", "j", "k")).when(m == 2, F.concat(s(", ", "i", "j"), F.lit(","), F.col("k").cast("string"))).when(m == 3, s("_", "i", "j")).when(m == 4, F.concat(s(" ", "i", "j"), F.lit("  "), F.col("k").cast("string"))).otherwise(F.concat(F.lit("x;"), s(";", "j", "k")))
    c = L.cells(spark, sf_dir).select("node_id", text.alias("ijk"))
    return grid.parse_ijk(c).select("node_id", "pi", "pj", "pk", "i0", "j0", "k0")


@query(with_(L.CELLS, "SELECT count(*) AS n_nodes, count(fe) AS n_fe, count(*) FILTER (fe IS NOT NULL AND g IS NULL) AS fe_only, count(*) FILTER (fe IS NULL AND g IS NOT NULL) AS other_only, count(*) FILTER (fe IS NOT NULL AND g IS NOT NULL) AS n_both FROM (SELECT fe, CASE WHEN (i + j) % 9 <> 0 THEN s0 END AS g FROM cells)"))
def covariate_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = L.cells(spark, sf_dir).withColumn("g", F.when((F.col("i") + F.col("j")) % 9 != 0, F.col("s0")))
    a, b = F.col("fe").isNotNull(), F.col("g").isNotNull()
    return c.agg(F.count("*").alias("n_nodes"), F.count("fe").alias("n_fe"), F.count_if(a & ~b).alias("fe_only"), F.count_if(~a & b).alias("other_only"), F.count_if(a & b).alias("n_both"))


# --- windows ---------------------------------------------------------------------------------

_WIN = (
    L.CELLS
    + ","
    + L.OFFSETS
    + """,
win AS (
  SELECT c.i + 0 AS i, c.j + 0 AS j, c.k + 0 AS k, o.o AS o, g.valid, g.fe, g.feo, g.magsus, g.s
  FROM (SELECT a.i, b.j, d.k FROM (SELECT unnest(generate_series(1, 22))::INT AS i) a, (SELECT unnest(generate_series(1, 18))::INT AS j) b, (SELECT unnest(generate_series(1, 10))::INT AS k) d) c, offsets o, cells g
  WHERE g.i = c.i + o.a AND g.j = c.j + o.b AND g.k = c.k + o.c),
cover AS (SELECT i, j, k, count(*) AS n_present, count(*) FILTER (valid) AS n_valid FROM win GROUP BY 1, 2, 3)"""
)


def _patterns(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    return grid.window_patterns(L.cells(spark, sf_dir), COV, L.DIMS, k)


@query(with_(_WIN, "SELECT i, j, k, n_present, n_valid, n_valid / 27.0 >= 0.7 AS accepted FROM cover"))
def voxel_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _patterns(spark, sf_dir)
    return p.select("i", "j", "k", "n_present", "n_valid", (F.col("n_valid") / 27.0 >= 0.7).alias("accepted"))


_FILL = (
    _WIN
    + """,
good AS (SELECT w.* FROM win w JOIN cover c USING (i, j, k) WHERE n_valid / 27.0 >= 0.7 AND w.valid),
weights AS (SELECT t.o AS t, f.o AS f, power(sqrt(power((t.a - f.a) * 5.0, 2) + power((t.b - f.b) * 5.0, 2) + power((t.c - f.c) * 2.0, 2)) + 1e-8, -2) AS w FROM offsets t, offsets f WHERE t.o <> f.o),
holes AS (SELECT c.i, c.j, c.k, o.o FROM cover c, offsets o WHERE n_valid / 27.0 >= 0.7 AND n_valid < 27 EXCEPT SELECT i, j, k, o FROM good),
filled AS (
  SELECT i, j, k, o, 0 AS missing, fe, feo, magsus, s FROM good
  UNION ALL
  SELECT h.i, h.j, h.k, h.o, 1, sum(w * fe) / sum(w), sum(w * feo) / sum(w), sum(w * magsus) / sum(w), sum(w * s) / sum(w)
  FROM holes h JOIN good g ON g.i = h.i AND g.j = h.j AND g.k = h.k JOIN weights x ON x.t = h.o AND x.f = g.o GROUP BY 1, 2, 3, 4)"""
)


def _filled(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    return grid.fill_idw(grid.accepted(_patterns(spark, sf_dir, k), k), COV, k, L.CELL)


@query(with_(_FILL, "SELECT i, j, k, o, missing, round(fe, 6) AS fe, round(feo, 4) AS feo, round(magsus, 6) AS magsus, round(s, 6) AS s FROM filled WHERE missing = 1"))
def idw_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _filled(spark, sf_dir).select("i", "j", "k", F.explode("filled").alias("v")).select("i", "j", "k", "v.*").filter("missing = 1")
    return v.select("i", "j", "k", "o", "missing", F.round("fe", 6).alias("fe"), F.round("feo", 4).alias("feo"), F.round("magsus", 6).alias("magsus"), F.round("s", 6).alias("s"))


@query(with_(_FILL, "SELECT i, j, k, round(avg(fe), 6) AS fe, round(avg(feo), 4) AS feo, round(avg(magsus), 6) AS magsus, round(avg(s), 6) AS s FROM filled GROUP BY 1, 2, 3"))
def voxel_window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda c: F.aggregate("filled", F.lit(0.0), lambda acc, v: acc + v[c]) / 27.0
    return _filled(spark, sf_dir).select("i", "j", "k", F.round(mean("fe"), 6).alias("fe"), F.round(mean("feo"), 4).alias("feo"), F.round(mean("magsus"), 6).alias("magsus"), F.round(mean("s"), 6).alias("s"))


_CHECKSUM = "round(sum((o * 5 + 1) * fe + (o * 5 + 2) * feo / 1000 + (o * 5 + 3) * magsus + (o * 5 + 4) * s + (o * 5 + 5) * missing), 4)"


def _weighted(col: str):
    """Sum over the features of place times value, FeO in thousands."""
    return F.round(F.aggregate(F.transform(col, lambda x, p: (p + 1) * F.when(p % 5 == 1, x / 1000).otherwise(x)), F.lit(0.0), lambda a, x: a + x), 4)


@query(with_(_FILL, f"SELECT i, j, k, 135 AS width, true AS layout_ok, {_CHECKSUM} AS checksum FROM filled GROUP BY 1, 2, 3"))
def voxel_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = grid.flatten_patterns(_filled(spark, sf_dir), COV)
    return p.select("i", "j", "k", F.size("features").alias("width"), grid.layout_ok(p).alias("layout_ok"), _weighted("features").alias("checksum"))


@query(with_(_WIN, "SELECT count(*) AS n_infer, count(*) FILTER (c.dtr IS NOT NULL AND c.magnetic IS NOT NULL) AS n_train, count(*) FILTER (c.dtr IS NOT NULL AND c.valid) AS n_train_valid FROM cover v LEFT JOIN cells c USING (i, j, k) WHERE n_valid / 27.0 >= 0.7"))
def train_infer_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = L.cells(spark, sf_dir)
    p = grid.accepted(_patterns(spark, sf_dir)).select("i", "j", "k").join(c, ["i", "j", "k"], "left")
    both = F.col("dtr").isNotNull() & F.col("magnetic").isNotNull()
    return p.agg(F.count("*").alias("n_infer"), F.count_if(both).alias("n_train"), F.count_if(F.col("dtr").isNotNull() & F.col("valid")).alias("n_train_valid"))


def _wider(sql: str) -> str:
    """The SQL of windows of 27 voxels for those of 125."""
    for old, new in (("[-1, 0, 1]", "[-2, -1, 0, 1, 2]"), ("((a + 1) * 3 + b + 1) * 3 + c + 1", "((a + 2) * 5 + b + 2) * 5 + c + 2"), ("(1, 22)", "(2, 21)"), ("(1, 18)", "(2, 17)"), ("(1, 10)", "(2, 9)"), ("27.0", "125.0"), ("n_valid < 27", "n_valid < 125")):
        sql = sql.replace(old, new)
    return sql


@query(with_(_wider(_WIN), "SELECT i, j, k, n_present, n_valid, n_valid / 125.0 >= 0.7 AS accepted FROM cover"))
def voxel_coverage_k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patterns(spark, sf_dir, 5).select("i", "j", "k", "n_present", "n_valid", (F.col("n_valid") / 125.0 >= 0.7).alias("accepted"))


@query(with_(_wider(_FILL), f"SELECT i, j, k, 625 AS width, true AS layout_ok, {_CHECKSUM} AS checksum FROM filled GROUP BY 1, 2, 3"))
def voxel_vectors_k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = grid.flatten_patterns(_filled(spark, sf_dir, 5), COV)
    return p.select("i", "j", "k", F.size("features").alias("width"), grid.layout_ok(p).alias("layout_ok"), _weighted("features").alias("checksum"))


_ROT = """,
turned AS (
  SELECT f.i, f.j, f.k, t.turn, p.o AS o, f.missing, f.fe, f.feo, f.magsus, f.s
  FROM filled f JOIN offsets q ON q.o = f.o, (SELECT unnest([0, 1, 2, 3]) AS turn) t, offsets p
  WHERE q.a = CASE t.turn WHEN 0 THEN p.a WHEN 1 THEN p.b WHEN 2 THEN -p.a ELSE -p.b END AND q.b = CASE t.turn WHEN 0 THEN p.b WHEN 1 THEN -p.a WHEN 2 THEN -p.b ELSE p.a END AND q.c = p.c)"""


@query(with_(_FILL + _ROT, f"SELECT i, j, k, turn, {_CHECKSUM} AS checksum FROM turned GROUP BY 1, 2, 3, 4"))
def rotate_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = grid.flatten_patterns(_filled(spark, sf_dir), COV).select("i", "j", "k", "features")
    return features.rotate(p, "features", 3).select("i", "j", "k", "turn", _weighted("features").alias("checksum"))


_AXES = features.rotation_matrix(30.0, 20.0)
_PACK = features.decay_pack(3, L.CELL, _AXES, (20.0, 10.0, 5.0))
_AXIS = {p: n for n, m in enumerate(_PACK[1]) for p in m}
_PACK_SQL = ",\npack AS (SELECT * FROM (VALUES " + ", ".join(f"({p}, CAST({w!r} AS DOUBLE), {_AXIS[p]})" for p, w in enumerate(_PACK[0])) + ") t(o, w, axis))"
_STATS_SQL = """,
parts AS (SELECT f.i, f.j, f.k, p.axis + 1 AS part, p.w, f.fe AS v FROM filled f JOIN pack p USING (o) UNION ALL SELECT f.i, f.j, f.k, 0, p.w, f.fe FROM filled f JOIN pack p USING (o)),
mids AS (SELECT i, j, k, part, sum(w * v) / sum(w) AS m FROM parts GROUP BY 1, 2, 3, 4),
mom AS (SELECT i, j, k, part, any_value(m) AS m, sum(w * power(v - m, 2)) / sum(w) AS s FROM parts JOIN mids USING (i, j, k, part) GROUP BY 1, 2, 3, 4),
stats AS (SELECT i, j, k, """ + ", ".join(f"max(m) FILTER (part = {n}) AS fe_{p}_mean, max(s) FILTER (part = {n}) AS fe_{p}_var" for n, p in enumerate(("all", "major", "semi", "minor"))) + " FROM mom GROUP BY 1, 2, 3)"
_STAT_NAMES = [f"fe_{p}_{m}" for p in ("all", "major", "semi", "minor") for m in ("mean", "var")]


def _oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.transform("filled", lambda v: v["fe"])
    return features.oriented_stats(_filled(spark, sf_dir), values, _PACK, "fe").select("i", "j", "k", *_STAT_NAMES)


@query(with_(_FILL + _PACK_SQL + _STATS_SQL, "SELECT i, j, k, " + ", ".join(f"round({n}, 6) AS {n}" for n in _STAT_NAMES) + " FROM stats"))
def aniso_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_oriented(spark, sf_dir))


_VARS = [n for n in _STAT_NAMES if n.endswith("var")]


@query(
    with_(
        _FILL + _PACK_SQL + _STATS_SQL + ",\nlg AS (SELECT i, j, k, " + ", ".join(f"ln(1 + greatest({n}, 0)) AS {n}" for n in _VARS) + " FROM stats),\nst AS (SELECT " + ", ".join(f"avg({n}) FILTER ((i + j) % 2 = 0) AS m_{n}, greatest(stddev_pop({n}) FILTER ((i + j) % 2 = 0), 1e-6) AS s_{n}" for n in _VARS) + " FROM lg)",
        "SELECT i, j, k, " + ", ".join(f"round(({n} - m_{n}) / s_{n}, 6) AS {n}" for n in _VARS) + " FROM lg, st",
    )
)
def aniso_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = (F.col("i") + F.col("j")) % 2 == 0
    return rounded(features.log_standardise(_oriented(spark, sf_dir), _VARS, train).select("i", "j", "k", *_VARS))


@query(with_(L.CELLS, "SELECT node_id, round(coalesce(fe, (SELECT median(fe) FROM cells WHERE fold <> 0)), 6) AS fe, round(coalesce(s, (SELECT median(s) FROM cells WHERE fold <> 0)), 6) AS s FROM cells"))
def impute_train_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.impute_median(L.cells(spark, sf_dir).select("node_id", "fold", "fe", "s"), ["fe", "s"], F.col("fold") != 0).drop("fold"))


_R = [[float(v) for v in row] for row in _AXES]


@query(with_(L.CELLS, "SELECT node_id, " + ", ".join(f"round((x * {r[0]!r} + y * {r[1]!r} + z * {r[2]!r}) / {s!r}, 6) AS {n}" for n, r, s in zip("uvw", _R, (20.0, 10.0, 5.0), strict=True)) + " FROM cells"))
def continuity_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = features.continuity_frame(_AXES, (20.0, 10.0, 5.0), F.col("x"), F.col("y"), F.col("z"))
    return rounded(L.cells(spark, sf_dir).select("node_id", *(c.alias(n) for n, c in zip("uvw", u, strict=True))))


# --- folds -----------------------------------------------------------------------------------

_NODES = ", nodes AS (SELECT * FROM cells WHERE dtr IS NOT NULL AND valid)"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cells(spark, sf_dir).filter("dtr is not null and valid")


def _edge_sql(axis: str, n: int, cell: float) -> str:
    inner = [f"lo_{axis} + (floor((hi_{axis} - lo_{axis}) * {m} / {n}.0 / {cell}) + 0.5) * {cell}" for m in range(1, n)]
    return " + ".join(f"CASE WHEN {axis} >= {e} THEN 1 ELSE 0 END" for e in inner) or "0"


@query(
    with_(
        L.CELLS + ", b AS (SELECT min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z FROM cells)",
        f"SELECT bid, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM (SELECT *, (({_edge_sql('x', 3, 5.0)}) * 4 + ({_edge_sql('y', 4, 5.0)})) * 2 + ({_edge_sql('z', 2, 2.0)}) AS bid FROM cells, b) GROUP BY 1",
    )
)
def block_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = L.cells(spark, sf_dir)
    b = c.agg(*(f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max)))).first()
    axes = [(a, folds.block_edges(b[f"lo_{a}"], b[f"hi_{a}"], n, s)) for a, n, s in zip("xyz", L.BLOCKS, L.CELL, strict=True)]
    return rounded(c.withColumn("bid", folds.block_id(axes)).groupBy("bid").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz")))


_ROLES = _NODES + ", roles AS (SELECT n.*, f.f, CASE WHEN n.node_id % 31 = 0 THEN -1 WHEN n.fold = f.f THEN 1 ELSE 0 END AS role FROM nodes n, (SELECT unnest([0, 1, 2, 3, 4]) AS f) f)"


@query(with_(L.CELLS + _ROLES, "SELECT node_id, f, role FROM roles"))
def fold_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.roles(_nodes(spark, sf_dir).select("node_id", "fold"), L.FOLDS, F.col("node_id") % 31 == 0).select("node_id", "f", "role")


_BUFFER = _NODES + """, buf AS (SELECT DISTINCT n.node_id, t.fold AS f FROM nodes n JOIN nodes t ON n.fold <> t.fold AND abs(n.x - t.x) <= 5 AND abs(n.y - t.y) <= 5 AND abs(n.z - t.z) <= 4),
roles AS (SELECT n.node_id, f.f, CASE WHEN n.fold = f.f THEN 1 WHEN b.node_id IS NOT NULL THEN 2 ELSE 0 END AS role FROM nodes n CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS f) f LEFT JOIN buf b ON b.node_id = n.node_id AND b.f = f.f)"""


def _buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nodes(spark, sf_dir)
    return folds.roles(n.select("node_id", "fold"), L.FOLDS, buffered=folds.buffer_nodes(n, (5.0, 5.0, 4.0)))


@query(with_(L.CELLS + _BUFFER, "SELECT node_id, f FROM roles WHERE role = 2"))
def buffer_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buffered(spark, sf_dir).filter("role = 2").select("node_id", "f")


@query(with_(L.CELLS + _BUFFER, "SELECT f AS fold, count(*) FILTER (role = 0) AS n_train, count(*) FILTER (role = 1) AS n_test, count(*) FILTER (role = 2) AS n_buffer, count(*) FILTER (role = -1) AS n_excluded, round(100.0 * count(*) FILTER (role = 2) / greatest(count(*) - count(*) FILTER (role = 1), 1), 6) AS buffer_pct FROM roles GROUP BY 1"))
def fold_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_stats(_buffered(spark, sf_dir))


@query(with_(L.CELLS + _NODES, "SELECT fold, count(*) AS n, round(median(d), 6) AS d50, round(max(d), 6) AS d_max FROM (SELECT t.node_id, t.fold, min(sqrt(power(t.x - r.x, 2) + power(t.y - r.y, 2) + power(t.z - r.z, 2))) AS d FROM nodes t JOIN nodes r ON r.fold <> t.fold GROUP BY 1, 2) GROUP BY 1"))
def cv_nn_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nodes(spark, sf_dir).select("node_id", "fold", "x", "y", "z")
    d = folds.nearest(n, n, "node_id", apart="fold").join(n.select("node_id", "fold"), "node_id")
    mid = quantiles(d, ["fold"], {"d50": F.col("dist")}, [0.5])
    top = d.groupBy("fold").agg(F.count("dist").alias("n"), F.max("dist").alias("d_max"))
    return rounded(top.join(mid, "fold").select("fold", "n", F.col("d50")[0].alias("d50"), "d_max"))


@query(with_(L.CELLS + _NODES, "SELECT count(*) AS n, " + ", ".join(f"round(quantile_cont(d, 0.{q}), 6) AS p{q}" for q in (10, 25, 50, 75, 95)) + " FROM (SELECT c.node_id, min(sqrt(power(c.x - r.x, 2) + power(c.y - r.y, 2) + power(c.z - r.z, 2))) AS d FROM cells c, nodes r GROUP BY 1)"))
def deploy_nn_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = settle(folds.nearest(L.cells(spark, sf_dir).select("node_id", "x", "y", "z"), _nodes(spark, sf_dir).select("x", "y", "z"), "node_id"))
    qs = (10, 25, 50, 75, 95)
    p = quantiles(d, [], {"p": F.col("dist")}, [q / 100 for q in qs]).crossJoin(d.agg(F.count("dist").alias("n")))  # a row each
    return rounded(p.select("n", *(F.col("p")[x].alias(f"p{q}") for x, q in enumerate(qs))))


@query(with_(L.CELLS + _ROLES + ", tr AS (SELECT f, fold, count(*) AS n FROM roles WHERE role = 0 GROUP BY 1, 2), ok AS (SELECT f, fold, n, sum(n) OVER (PARTITION BY f) - n AS rest FROM tr)", "SELECT f AS outer, fold AS inner, CAST(rest AS BIGINT) AS n_train, n AS n_valid FROM (SELECT *, count(*) OVER (PARTITION BY f) AS c FROM ok WHERE rest >= 10 AND n >= 2) WHERE c >= 2"))
def inner_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.inner_splits(folds.roles(_nodes(spark, sf_dir).select("node_id", "fold"), L.FOLDS, F.col("node_id") % 31 == 0))


@query(
    with_(
        L.CELLS + _NODES + ", centres AS (SELECT block AS route, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM nodes GROUP BY 1)",
        "SELECT node_id, route FROM (SELECT c.node_id, t.route, row_number() OVER (PARTITION BY c.node_id ORDER BY round(power(c.x - cx, 2) + power(c.y - cy, 2) + power(c.z - cz, 2), 9), t.route) AS r FROM cells c, centres t) WHERE r = 1",
    )
)
def route_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = _nodes(spark, sf_dir).groupBy("block").agg(*(F.avg(a).alias(a) for a in "xyz"))
    return folds.route_to_blocks(L.cells(spark, sf_dir).select("node_id", "x", "y", "z"), centres).select("node_id", "route")


_MERGE = _NODES + """,
blocks AS (SELECT block, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM nodes GROUP BY 1),
merging(groups, roots) AS (
  SELECT list({'n': n, 'root': block, 'x': x, 'y': y, 'z': z}), list({'block': block, 'root': block}) FROM blocks
  UNION ALL
  SELECT list_append(list_filter(groups, lambda g: g.root <> s.root AND g.root <> t.root), {'n': s.n + t.n, 'root': least(s.root, t.root), 'x': (s.x * s.n + t.x * t.n) / (s.n + t.n), 'y': (s.y * s.n + t.y * t.n) / (s.n + t.n), 'z': (s.z * s.n + t.z * t.n) / (s.n + t.n)}),
    list_transform(roots, lambda r: {'block': r.block, 'root': CASE WHEN r.root = greatest(s.root, t.root) THEN least(s.root, t.root) ELSE r.root END})
  FROM (
    SELECT *, list_sort(list_transform(list_filter(groups, lambda g: g.root <> s.root), lambda g: {'d': power(g.x - s.x, 2) + power(g.y - s.y, 2) + power(g.z - s.z, 2), 'root': g.root, 'n': g.n, 'x': g.x, 'y': g.y, 'z': g.z}))[1] AS t
    FROM (SELECT *, list_sort(groups)[1] AS s FROM merging WHERE len(groups) > 1) WHERE s.n < 12)),
merged AS (SELECT unnest(roots) AS r FROM (SELECT roots FROM merging ORDER BY len(groups) LIMIT 1))"""


@query("WITH RECURSIVE " + L.CELLS + _MERGE + " SELECT b.block, b.n, CAST(r.root AS INT) AS merged FROM blocks b JOIN merged ON r.block = b.block")
def block_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks under 12 samples join their nearest neighbours."""
    n = _nodes(spark, sf_dir)
    merged = folds.merge_small(folds.block_summary(n), 12)
    return n.groupBy("block").agg(F.count("*").alias("n")).join(spark.createDataFrame(sorted(merged.items()), "block int, merged int"), "block")


_FOLD_SEARCH = _NODES + """,
sizes AS (SELECT block, count(*) AS n, row_number() OVER (ORDER BY block) AS ord FROM nodes GROUP BY 1),
trials AS (SELECT unnest(generate_series(0, 799))::INT AS trial),
turns AS (SELECT trial, block, n, row_number() OVER (PARTITION BY trial ORDER BY sha1('42:' || trial || ':' || block), block) AS turn FROM trials, sizes),
greedy(trial, turn, block, fold, load) AS (
  SELECT trial, CAST(0 AS BIGINT), CAST(NULL AS INT), CAST(NULL AS INT), CAST([0, 0, 0, 0, 0] AS BIGINT[]) FROM trials
  UNION ALL
  SELECT t.trial, t.turn, t.block, CAST(list_position(g.load, list_min(g.load)) - 1 AS INT), list_transform(g.load, lambda x, p: x + CASE WHEN p = list_position(g.load, list_min(g.load)) THEN t.n ELSE 0 END)
  FROM greedy g JOIN turns t ON t.trial = g.trial AND t.turn = g.turn + 1),
asg AS (SELECT trial, block, fold FROM greedy WHERE turn > 0),
reach AS (SELECT a.node_id, a.block AS home, b.block, min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2))) AS d FROM nodes a, nodes b GROUP BY 1, 2, 3),
away AS (SELECT h.trial, h.fold, r.node_id, min(r.d) AS d FROM reach r JOIN asg h ON h.block = r.home JOIN asg o ON o.trial = h.trial AND o.block = r.block AND o.fold <> h.fold GROUP BY 1, 2, 3),
mids AS (SELECT trial, fold, median(d) AS d50 FROM away GROUP BY 1, 2),
loads AS (SELECT trial, f AS fold, coalesce(sum(n), 0) AS n FROM trials CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS f) LEFT JOIN (SELECT trial AS t2, fold, n FROM asg JOIN sizes USING (block)) ON t2 = trial AND fold = f GROUP BY 1, 2)"""


@query(
    "WITH RECURSIVE " + L.CELLS + _FOLD_SEARCH + " SELECT trial, round(stddev_pop(n) / avg(n) + stddev_pop(d50) / greatest(median(d50), 1e-9), 6) AS score, (SELECT string_agg(CAST(fold AS VARCHAR), ',' ORDER BY block) FROM asg a WHERE a.trial = l.trial) AS folds FROM loads l LEFT JOIN mids USING (trial, fold) GROUP BY trial"
)
def fold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """800 greedy assignments of blocks to folds with their scores."""
    return rounded(folds.search_folds(settle(_nodes(spark, sf_dir).select("node_id", "block", "x", "y", "z")), L.FOLDS))


# k3 and pts share a group, whose radius is the wider of theirs; k5 has its own
_GROUPS = [("k3", "near", 3), ("pts", "near", 2), ("k5", "wide", 5)]
_GROUP_SQL = _NODES + """,
sets(dataset, grp, kernel) AS (VALUES ('k3', 'near', 3), ('pts', 'near', 2), ('k5', 'wide', 5)),
points AS (
  SELECT 'k3' AS dataset, node_id, x, y, z, CASE WHEN node_id % 31 <> 0 THEN fold END AS fold FROM nodes
  UNION ALL SELECT 'pts', node_id, x + 0.5, y - 0.25, z, fold FROM nodes WHERE node_id % 3 = 0
  UNION ALL SELECT 'k5', node_id, x, y, z, fold FROM cells WHERE magnetic IS NOT NULL AND valid AND node_id % 2 = 0),
radii AS (SELECT mode, grp, max(kernel - 1 + extra) AS w FROM sets, (VALUES ('exact', 0), ('safety', 1)) m(mode, extra) GROUP BY 1, 2),
held AS (SELECT DISTINCT r.mode, p.dataset, p.node_id, t.fold AS f FROM points p JOIN sets s USING (dataset) JOIN radii r USING (grp) JOIN sets u ON u.grp = s.grp JOIN points t ON t.dataset = u.dataset AND p.fold <> t.fold AND abs(p.x - t.x) <= 5.0 * w AND abs(p.y - t.y) <= 5.0 * w AND abs(p.z - t.z) <= 2.0 * w)"""


@query(
    with_(
        L.CELLS + _GROUP_SQL,
        "SELECT m.mode, p.dataset, p.node_id, f.f, CASE WHEN p.fold IS NULL THEN -1 WHEN p.fold = f.f THEN 1 WHEN h.f IS NOT NULL THEN 2 ELSE 0 END AS role FROM points p CROSS JOIN (SELECT unnest(['none', 'exact', 'safety']) AS mode) m CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS f) f LEFT JOIN held h ON h.mode = m.mode AND h.dataset = p.dataset AND h.node_id = p.node_id AND h.f = f.f",
    )
)
def group_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of three datasets in two buffer groups under each buffer mode."""
    c = L.cells(spark, sf_dir)
    n = c.filter("dtr is not null and valid")
    k3 = n.select(F.lit("k3").alias("dataset"), "node_id", "x", "y", "z", F.when(F.col("node_id") % 31 != 0, F.col("fold")).alias("fold"))
    pts = n.filter("node_id % 3 = 0").select(F.lit("pts").alias("dataset"), "node_id", (F.col("x") + 0.5).alias("x"), (F.col("y") - 0.25).alias("y"), "z", "fold")
    k5 = c.filter("magnetic is not null and valid and node_id % 2 = 0").select(F.lit("k5").alias("dataset"), "node_id", "x", "y", "z", "fold")
    sets = spark.createDataFrame(_GROUPS, "dataset string, grp string, kernel int")
    return folds.group_roles(k3.unionByName(pts).unionByName(k5), sets, L.FOLDS, L.CELL)


# --- joins -----------------------------------------------------------------------------------

_SHIFT = ", moved AS (SELECT node_id AS other_id, x + 0.12 + 0.13 * (j % 2) AS x, y - 0.2 AS y, z + 0.1 * (i % 3) AS z, fold AS fold_other, round(feo0, 6) AS y_other FROM cells WHERE node_id % 11 <> 0)"


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = L.cells(spark, sf_dir).filter("node_id % 11 <> 0")
    return c.select(F.col("node_id").alias("other_id"), (F.col("x") + 0.12 + 0.13 * (F.col("j") % 2)).alias("x"), (F.col("y") - 0.2).alias("y"), (F.col("z") + 0.1 * (F.col("i") % 3)).alias("z"), F.col("fold").alias("fold_other"), F.round("feo0", 6).alias("y_other"))


@query(with_(L.CELLS + _SHIFT, "SELECT node_id, other_id, round(d, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY d, other_id) AS r FROM (SELECT c.node_id, m.other_id, sqrt(power(c.x - m.x, 2) + power(c.y - m.y, 2) + power(c.z - m.z, 2)) AS d FROM cells c JOIN moved m ON abs(c.x - m.x) < 1 AND abs(c.y - m.y) < 1 AND abs(c.z - m.z) < 1) WHERE d < 1) WHERE r = 1 AND d <= 0.5"))
def tolerance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(joins.common_support(L.cells(spark, sf_dir), _moved(spark, sf_dir), "node_id", "other_id"))


@query(with_(L.CELLS + _SHIFT, "SELECT count(*) AS n, round(max(abs(round(c.feo0, 6) - m.y_other)), 6) AS max_diff, avg(CAST(c.fold = m.fold_other AS DOUBLE)) AS fold_agreement, true AS ok FROM cells c JOIN moved m ON m.other_id = c.node_id"))
def join_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m = L.cells(spark, sf_dir), _moved(spark, sf_dir)
    met = joins.common_support(c, m, "node_id", "other_id").join(c.select("node_id", "fold", F.round("feo0", 6).alias("y_true")), "node_id").join(m.select("other_id", "fold_other", "y_other"), "other_id")
    return rounded(joins.verify_joined(met))


@query(with_(L.CELLS + _SHIFT, "SELECT count(*) FILTER (m.other_id IS NOT NULL) AS n_both, count(*) FILTER (m.other_id IS NULL) AS only_left, CAST(0 AS BIGINT) AS only_right, round(max(greatest(abs(c.x - m.x), abs(c.y - m.y), abs(c.z - m.z))), 6) AS max_gap, false AS aligned FROM cells c LEFT JOIN moved m ON m.other_id = c.node_id"))
def alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(joins.alignment(L.cells(spark, sf_dir), _moved(spark, sf_dir).withColumnRenamed("other_id", "node_id"), "node_id"))


_RUN_SQL = "SELECT count(*) AS n, min(node_id) AS first, CASE WHEN bool_and({ok}) THEN 'whole' END AS support, count(DISTINCT fold) AS folds, {kernel} AS kernel, round(max(fe0), 6) AS top FROM cells WHERE {ok}"


@query(
    with_(
        L.CELLS + f", a AS ({_RUN_SQL.format(ok='true', kernel='3')}), b AS ({_RUN_SQL.format(ok='valid', kernel='NULL')})",
        " UNION ALL ".join(f"SELECT '{c}' AS field, CAST(a.{c} AS VARCHAR) AS left, CAST(b.{c} AS VARCHAR) AS right, a.{c} IS NOT DISTINCT FROM b.{c} AS same FROM a, b" for c in ("n", "first", "support", "folds", "kernel")),
    )
)
def provenance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two runs say of their data: one over all cells, one over the covered ones."""

    def record(c: DataFrame, kernel: int | None) -> DataFrame:
        return c.agg(F.count("*").alias("n"), F.min("node_id").alias("first"), F.lit("whole").alias("support"), F.count_distinct("fold").alias("folds")).withColumn("kernel", F.lit(kernel).cast("int"))

    c = L.cells(spark, sf_dir)
    return joins.provenance_matches(record(c, 3), record(c.filter("valid"), None), ["n", "first", "support", "folds", "kernel"])


@query(with_(L.LONG, "SELECT a.target, a.method AS method_a, b.method AS method_b, count(*) AS n, round(avg(abs(a.y_pred - a.y_true) - abs(b.y_pred - b.y_true)), 6) AS mean_gap, count(*) FILTER (abs(a.y_pred - a.y_true) < abs(b.y_pred - b.y_true)) AS wins_a FROM long a JOIN long b ON a.target = b.target AND a.node_id = b.node_id AND a.method < b.method GROUP BY 1, 2, 3"))
def method_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = joins.method_pairs(L.long(spark, sf_dir))
    a, b = F.abs("err_a"), F.abs("err_b")
    return rounded(p.groupBy("target", "method_a", "method_b").agg(F.count("*").alias("n"), F.avg(a - b).alias("mean_gap"), F.count_if(a < b).alias("wins_a")))


# --- measures --------------------------------------------------------------------------------

_ACC = "count(*) AS n, round(1 - sum(power(y_true - y_pred, 2)) / greatest(var_pop(y_true) * count(y_true), 1e-300), 6) AS r2, round(sqrt(avg(power(y_true - y_pred, 2))), 6) AS rmse, round(avg(abs(y_true - y_pred)), 6) AS mae, round(2 * covar_pop(y_true, y_pred) / (var_pop(y_true) + var_pop(y_pred) + power(avg(y_true) - avg(y_pred), 2)), 6) AS ccc"


@query(with_(L.LONG, f"SELECT target, method, {_ACC} FROM long GROUP BY 1, 2"))
def pooled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.scored(L.long(spark, sf_dir), KEYS))


@query(with_(L.LONG, f"SELECT target, method, fold, {_ACC} FROM long GROUP BY 1, 2, 3"))
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.scored(L.long(spark, sf_dir), (*KEYS, "fold")))


@query(with_(L.LONG + f", per AS (SELECT target, method, fold, {_ACC} FROM long GROUP BY 1, 2, 3)", "SELECT target, method, round(avg(r2), 5) AS r2_mean, round(stddev_pop(r2), 5) AS r2_std, round(avg(rmse), 5) AS rmse_mean, round(stddev_pop(rmse), 5) AS rmse_std FROM per GROUP BY 1, 2"))
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.across_folds(fold_metrics(spark, sf_dir), KEYS, ["r2", "rmse"]), 5)


_EVENT = ", ev AS (SELECT l.*, y_true > thr AS event, 1 / (1 + exp(-(y_pred - thr) / 2)) AS p FROM long l JOIN (SELECT target, median(v) AS thr FROM fields GROUP BY 1) USING (target))"


@query(
    with_(
        L.LONG + _EVENT + ", rk AS (SELECT *, rank() OVER (PARTITION BY target, method ORDER BY y_pred) + (count(*) OVER (PARTITION BY target, method, y_pred) - 1) / 2.0 AS rk FROM ev)",
        "SELECT target, method, count(*) AS n, CAST(count(*) FILTER (event) AS BIGINT) AS n_pos, round((sum(rk) FILTER (event) - count(*) FILTER (event) * (count(*) FILTER (event) + 1) / 2.0) / (count(*) FILTER (event) * count(*) FILTER (NOT event)), 6) AS auc, round(avg(power(p - CAST(event AS DOUBLE), 2)), 6) AS brier FROM rk GROUP BY 1, 2",
    )
)
def brier_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = L.long(spark, sf_dir)
    cut = L.fields(spark, sf_dir).groupBy("target").agg(F.median("v").alias("thr"))
    l = l.join(F.broadcast(cut), "target").withColumn("event", F.col("y_true") > F.col("thr")).withColumn("p", 1 / (1 + F.exp(-(F.col("y_pred") - F.col("thr")) / 2)))
    return rounded(metrics.auc(l, KEYS, "y_pred", "event").join(l.groupBy(*KEYS).agg(metrics.brier(F.col("p"), F.col("event")).alias("brier")), list(KEYS)))


_CLS = ", cuts AS (SELECT target, quantile_cont(v, 0.33) AS c1, quantile_cont(v, 0.67) AS c2 FROM fields GROUP BY 1), cls AS (SELECT l.target, method, CAST(y_true >= c1 AS INT) + CAST(y_true >= c2 AS INT) AS ct, CAST(y_pred >= c1 AS INT) + CAST(y_pred >= c2 AS INT) AS cp FROM long l JOIN cuts USING (target))"


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fields(spark, sf_dir).groupBy("target").agg(F.percentile("v", F.lit(0.33)).alias("c1"), F.percentile("v", F.lit(0.67)).alias("c2"))


@query(with_(L.LONG + _CLS + ", rc AS (SELECT target, method, ct, avg(CAST(ct = cp AS DOUBLE)) AS recall, count(*) AS n FROM cls GROUP BY 1, 2, 3)", "SELECT target, method, round(1 - avg(recall), 6) AS balanced_error, round(sum(recall * n) / sum(n), 6) AS accuracy, count(*) AS n_classes FROM rc GROUP BY 1, 2"))
def balanced_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = L.long(spark, sf_dir).join(F.broadcast(_cuts(spark, sf_dir)), "target")
    c = [F.col("c1"), F.col("c2")]
    l = l.withColumns({"ct": coherence.classes(F.col("y_true"), c), "cp": coherence.classes(F.col("y_pred"), c)})
    return rounded(metrics.balanced_error(l, KEYS, "ct", "cp"))


@query(with_(L.LONG + ", pr AS (SELECT target, node_id, y_pred / sum(y_pred) OVER (PARTITION BY target, node_id) AS p, count(*) OVER (PARTITION BY target, node_id) AS k FROM long)", "SELECT target, node_id, round(CASE WHEN max(k) < 2 THEN 0 ELSE -sum(least(greatest(p, 1e-12), 1) * ln(least(greatest(p, 1e-12), 1))) / ln(max(k)) END, 6) AS entropy FROM pr GROUP BY 1, 2"))
def class_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = L.long(spark, sf_dir).groupBy("target", "node_id").agg(F.array_sort(F.collect_list("y_pred")).alias("p"), F.sum("y_pred").alias("t"))
    return rounded(p.select("target", "node_id", metrics.entropy(F.transform("p", lambda x: x / F.col("t"))).alias("entropy")))


@query(with_(L.LONG, "SELECT target, method, round(var_samp(y_pred) / var_samp(y_true), 4) AS smoothing_ratio, round(avg(y_pred - y_true), 4) AS mean_error, round(stddev_samp(y_true), 4) AS sd_true, round(stddev_samp(y_pred), 4) AS sd_pred, round(regr_slope(y_true, y_pred), 4) AS slope, round(regr_intercept(y_true, y_pred), 4) AS intercept FROM long GROUP BY 1, 2"))
def dist_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.smoothing(L.long(spark, sf_dir), KEYS), 4)


@query(
    with_(
        L.LONG + ", st AS (SELECT target, method, y_true AS v, 1 AS t, 0 AS p FROM long UNION ALL SELECT target, method, y_pred, 0, 1 FROM long), cum AS (SELECT target, method, sum(t) OVER r AS ct, sum(p) OVER r AS cp, sum(t) OVER w AS nt, sum(p) OVER w AS np FROM st WINDOW r AS (PARTITION BY target, method ORDER BY v RANGE UNBOUNDED PRECEDING), w AS (PARTITION BY target, method))",
        "SELECT target, method, round(max(abs(ct / nt - cp / np)), 6) AS ks FROM cum GROUP BY 1, 2",
    )
)
def ks_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ks(L.long(spark, sf_dir), KEYS))


_QS = (0.5, 0.75, 0.9, 0.95, 0.99)


@query(with_(L.LONG, " UNION ALL ".join(f"SELECT target, method, CAST({q} AS DOUBLE) AS q, round(quantile_cont(y_true, {q}), 6) AS q_true, round(quantile_cont(y_pred, {q}), 6) AS q_pred, round(quantile_cont(y_pred, {q}) - quantile_cont(y_true, {q}), 6) AS error FROM long GROUP BY 1, 2" for q in _QS)))
def quantile_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.quantile_errors(L.long(spark, sf_dir), KEYS, _QS))


@query(with_(L.LONG + ", q AS (" + " UNION ALL ".join(f"SELECT target, method, abs(quantile_cont(y_pred, {q}) - quantile_cont(y_true, {q})) AS e FROM long GROUP BY 1, 2" for q in _QS[1:]) + ")", "SELECT target, method, round(avg(e), 6) AS tail_mae FROM q GROUP BY 1, 2"))
def tail_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.quantile_errors(L.long(spark, sf_dir), KEYS, _QS).filter("q >= 0.75").groupBy(*KEYS).agg(F.avg(F.abs("error")).alias("tail_mae")))


@query(
    with_(
        L.LONG + ", span AS (SELECT target, method, quantile_cont(y_true, 0.02) AS lo, quantile_cont(y_true, 0.98) AS hi FROM long GROUP BY 1, 2), cuts AS (SELECT target, method, step, lo + (hi - lo) * step / 39 AS cutoff FROM span, (SELECT unnest(generate_series(0, 39))::INT AS step))",
        "SELECT target, method, step, round(cutoff, 8) AS cutoff, round(avg(CAST(y_true >= cutoff AS DOUBLE)), 8) AS share_true, round(avg(y_true) FILTER (y_true >= cutoff), 8) AS mean_true, round(avg(CAST(y_pred >= cutoff AS DOUBLE)), 8) AS share_pred, round(avg(y_pred) FILTER (y_pred >= cutoff), 8) AS mean_pred FROM long JOIN cuts USING (target, method) GROUP BY target, method, step, cutoff",
    )
)
def selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.selectivity(L.long(spark, sf_dir), KEYS), 8)


@query(with_(L.FIELDS, "SELECT target, node_id, v, round(row_number() OVER (PARTITION BY target ORDER BY v, node_id) / count(*) OVER (PARTITION BY target), 9) AS ecdf FROM fields"))
def ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ecdf(L.fields(spark, sf_dir), ["target"], "v").select("target", "node_id", "v", "ecdf"), 9)


_WILC = ", d AS (SELECT a.target, a.method AS method_a, b.method AS method_b, round(abs(a.y_pred - a.y_true) - abs(b.y_pred - b.y_true), 6) AS d FROM long a JOIN long b ON a.target = b.target AND a.node_id = b.node_id AND a.method < b.method), rk AS (SELECT *, rank() OVER (PARTITION BY target, method_a, method_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY target, method_a, method_b, abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY target, method_a, method_b, abs(d)) AS tie FROM d WHERE d <> 0), w AS (SELECT target, method_a, method_b, count(*) AS n_diff, CAST(coalesce(sum(rk) FILTER (d > 0), 0) AS DOUBLE) AS w_plus, CAST(coalesce(sum(rk) FILTER (d < 0), 0) AS DOUBLE) AS w_minus, CAST(sum(tie * tie - 1) AS DOUBLE) AS t FROM rk GROUP BY 1, 2, 3)"


def _wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = joins.method_pairs(L.long(spark, sf_dir))
    return metrics.signed_rank(p, ["target", "method_a", "method_b"], F.round(F.abs("err_a") - F.abs("err_b"), 6))


@query(with_(L.LONG + _WILC, "SELECT target, method_a, method_b, n_diff, w_plus, w_minus, round((least(w_plus, w_minus) - n_diff * (n_diff + 1.0) / 4) / sqrt(n_diff * (n_diff + 1.0) * (2 * n_diff + 1.0) / 24 - t / 48), 6) AS z FROM w"))
def wilcoxon_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_wilcoxon(spark, sf_dir))


def _erfc_sql(x: str) -> str:
    t = f"(1 / (1 + 0.5 * {x}))"
    poly = f"CAST({ERFC[-1]!r} AS DOUBLE)"
    for a in reversed(ERFC[:-1]):
        poly = f"(CAST({a!r} AS DOUBLE) + {t} * {poly})"
    return f"{t} * exp(-{x} * {x} + {poly})"


@query(
    with_(
        L.LONG + _WILC + ", zs AS (SELECT *, (least(w_plus, w_minus) - n_diff * (n_diff + 1.0) / 4) / sqrt(n_diff * (n_diff + 1.0) * (2 * n_diff + 1.0) / 24 - t / 48) AS z FROM w), xs AS (SELECT *, abs(z) / sqrt(2) AS x FROM zs), ps AS (SELECT *, " + _erfc_sql("x") + " AS p FROM xs)",
        "SELECT target, method_a, method_b, n_diff, w_plus, w_minus, round(z, 6) AS z, round(p, 6) AS p, CASE WHEN p < 0.05 THEN CASE WHEN w_plus < w_minus THEN method_a ELSE method_b END END AS better FROM ps",
    )
)
def wilcoxon_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided p and the method with the smaller errors where p is under 0.05."""
    w = _wilcoxon(spark, sf_dir).withColumn("p", metrics.p_value(F.col("z")))
    better = F.when(F.col("w_plus") < F.col("w_minus"), F.col("method_a")).otherwise(F.col("method_b"))
    return rounded(w.withColumn("better", F.when(F.col("p") < 0.05, better)))


_TAU = f", per AS (SELECT target, fold, method, sqrt(avg(power(y_true - y_pred, 2))) AS rmse, avg(abs(y_true - y_pred)) AS mae FROM long GROUP BY 1, 2, 3), pairs AS (SELECT a.target, a.fold, sign(round(a.rmse, 6) - round(b.rmse, 6)) AS s1, sign(round(a.mae, 6) - round(b.mae, 6)) AS s2 FROM per a JOIN per b ON a.target = b.target AND a.fold = b.fold AND a.method < b.method)"


@query(with_(L.LONG + _TAU, "SELECT target, fold, count(*) AS n_pairs, round(CASE WHEN sum(abs(s1)) > 0 AND sum(abs(s2)) > 0 THEN sum(s1 * s2) / sqrt(sum(abs(s1)) * sum(abs(s2))) END, 6) AS tau FROM pairs GROUP BY 1, 2"))
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.kendall_tau(fold_metrics(spark, sf_dir), ["target", "fold"], "method", "rmse", "mae"))


# --- selection and reports -------------------------------------------------------------------


@query(with_(L.SCORES, "SELECT target, fold, config_id, score, CAST(row_number() OVER (PARTITION BY target, fold ORDER BY score DESC NULLS LAST, config_id) AS INT) AS rank, row_number() OVER (PARTITION BY target, fold ORDER BY score DESC NULLS LAST, config_id) = 1 AS selected FROM scores"))
def config_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rank_configs(L.scores(spark, sf_dir), ["target", "fold"]).select("target", "fold", "config_id", "score", "rank", "selected")


_SEL = ", sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, fold ORDER BY score DESC, config_id) AS r FROM scores) WHERE r = 1)"


@query(with_(L.SCORES + _SEL, "SELECT target, config_id, times, round(mean_score, 6) AS mean_score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY times DESC, mean_score DESC, config_id) AS r FROM (SELECT target, config_id, count(*) AS times, avg(score) AS mean_score FROM sel GROUP BY 1, 2)) WHERE r = 1"))
def modal_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reports.best(L.scores(spark, sf_dir), ["target", "fold"], "score", "config_id")
    return rounded(reports.modal_config(s, ["target"], "config_id", "score"))


@query(with_(L.SCORES, "SELECT *, CAST(row_number() OVER (ORDER BY mean DESC, target, a, b) AS INT) AS rank FROM (SELECT target, CASE WHEN a = 1 THEN NULL ELSE a END AS a, b, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, count(score) AS n FROM scores GROUP BY ALL)"))
def mean_config_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.scores(spark, sf_dir).withColumn("a", F.when(F.col("a") != 1, F.col("a")))
    m = rounded(reports.mean_scores(s, ["target", "a", "b"])).drop("rank")
    from pyspark.sql import Window as W

    order = [F.col("mean").desc(), F.col("target"), F.col("a").asc_nulls_last(), F.col("b")]
    return m.withColumn("rank", F.row_number().over(W.orderBy(*order)))


@query(with_(L.SCORES, "SELECT a, b, round(avg(m), 6) AS mean_best FROM (SELECT target, fold, a, b, max(score) AS m FROM scores GROUP BY 1, 2, 3, 4) GROUP BY 1, 2"))
def best_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = L.scores(spark, sf_dir).groupBy("target", "fold", "a", "b").agg(F.max("score").alias("m"))
    return rounded(top.groupBy("a", "b").agg(F.avg("m").alias("mean_best")))


_EFF = " UNION ALL ".join(f"SELECT '{f}' AS factor, CAST({f} AS VARCHAR) AS level, round(median(score), 9) AS median, round(quantile_cont(score, 0.25), 9) AS q25, round(quantile_cont(score, 0.75), 9) AS q75, max(score) AS max FROM scores GROUP BY {f}" for f in "ab")


@query(with_(L.SCORES, _EFF))
def marginal_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.marginal_effects(L.scores(spark, sf_dir), ["a", "b"]), 9)


@query(with_(L.SCORES + f", eff AS ({_EFF}), top AS (SELECT factor, CAST(level AS DOUBLE) AS l, row_number() OVER (PARTITION BY factor ORDER BY median DESC, CAST(level AS DOUBLE)) AS r, min(CAST(level AS DOUBLE)) OVER (PARTITION BY factor) AS lo, max(CAST(level AS DOUBLE)) OVER (PARTITION BY factor) AS hi FROM eff)", "SELECT factor, l AS best_level, CASE WHEN l = lo THEN 'low' WHEN l = hi THEN 'high' ELSE 'inside' END AS flag FROM top WHERE r = 1"))
def boundary_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.boundary_flags(marginal_effects(spark, sf_dir))


@query(with_(L.SCORES, "SELECT 'b' AS factor, count(*) AS n, round(avg(h.score - l.score), 6) AS mean_diff, count(*) FILTER (h.score > l.score) AS wins FROM scores h JOIN scores l USING (target, fold, a) WHERE h.b = 3 AND l.b = 0"))
def paired_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.paired_effects(L.scores(spark, sf_dir), "b", 0, 3, ["target", "fold", "a"]))


@query(with_(L.LONG + ", per AS (SELECT target, method, fold, avg(abs(y_true - y_pred)) AS test, (SELECT avg(abs(o.y_true - o.y_pred)) FROM long o WHERE o.target = l.target AND o.method = l.method AND o.fold <> l.fold) AS train FROM long l GROUP BY 1, 2, 3)", "SELECT target, method, round(avg(train - test), 6) AS gap, round(avg(train), 6) AS train, round(avg(test), 6) AS test FROM per GROUP BY 1, 2"))
def internal_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    l = L.long(spark, sf_dir).groupBy(*KEYS, "fold").agg(F.sum(F.abs(F.col("y_true") - F.col("y_pred"))).alias("s"), F.count("*").alias("n"))
    whole = W.partitionBy(*KEYS)
    l = l.withColumns({"test": F.col("s") / F.col("n"), "train": (F.sum("s").over(whole) - F.col("s")) / F.nullif(F.sum("n").over(whole) - F.col("n"), F.lit(0))})
    return rounded(l.groupBy(*KEYS).agg(F.avg(F.col("train") - F.col("test")).alias("gap"), F.avg("train").alias("train"), F.avg("test").alias("test")))


@query(with_(L.LONG + f", per AS (SELECT target, method, fold, {_ACC} FROM long GROUP BY 1, 2, 3)", "SELECT target, method, " + ", ".join(f"round(max(rmse) FILTER (fold = {f}), 6) AS fold{f}" for f in range(5)) + " FROM per GROUP BY 1, 2"))
def pivot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reports.pivoted(fold_metrics(spark, sf_dir), KEYS, "fold", range(5), F.max("rmse"))
    return p.select(*KEYS, *(F.col(str(f)).alias(f"fold{f}") for f in range(5)))


_ORDER = {"NBR": 1, "COL": 2, "BLK": 3}


@query(with_(L.LONG, "SELECT CASE method WHEN 'NBR' THEN 1 WHEN 'COL' THEN 2 ELSE 3 END AS place, CASE method WHEN 'NBR' THEN 'Neighbours' WHEN 'COL' THEN 'Column' ELSE 'Blocks' END AS label, count(*) AS n FROM long GROUP BY 1, 2"))
def method_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("NBR", 1, "Neighbours"), ("COL", 2, "Column"), ("BLK", 3, "Blocks")], "method string, place int, label string")
    return L.long(spark, sf_dir).join(F.broadcast(names), "method").groupBy("place", "label").agg(F.count("*").alias("n"))


_TREES = ", trees AS (SELECT target, node_id, c, y_pred * (CAST(0.94 AS DOUBLE) + CAST(0.01 AS DOUBLE) * c) AS p FROM long, (SELECT unnest(generate_series(0, 11))::INT AS c) WHERE method = 'NBR'), thr AS (SELECT target, quantile_cont(v, 0.55) AS t1, quantile_cont(v, 0.8) AS t2 FROM fields GROUP BY 1), unc AS (SELECT target, node_id, avg(p) AS y_pred, stddev_pop(p) AS y_unc, avg(CAST(p > t1 AS DOUBLE)) AS p_gt1, avg(CAST(p > t2 AS DOUBLE)) AS p_gt2 FROM trees JOIN thr USING (target) GROUP BY 1, 2)"


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    thr = L.fields(spark, sf_dir).groupBy("target").agg(F.percentile("v", F.lit(0.55)).alias("t1"), F.percentile("v", F.lit(0.8)).alias("t2"))
    t = L.long(spark, sf_dir).filter("method = 'NBR'").select("target", "node_id", "y_pred", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("c"))
    t = t.withColumn("p", F.col("y_pred") * (0.94 + 0.01 * F.col("c"))).join(F.broadcast(thr), "target")
    over = lambda c: F.avg((F.col("p") > F.col(c)).cast("double"))
    return t.groupBy("target", "node_id").agg(F.avg("p").alias("y_pred"), F.stddev_pop("p").alias("y_unc"), over("t1").alias("p_gt1"), over("t2").alias("p_gt2"))


@query(with_(L.LONG + _TREES, "SELECT target, node_id, round(y_pred, 9) AS y_pred, round(y_unc, 6) AS y_unc, round(p_gt1, 6) AS p_gt1, round(p_gt2, 6) AS p_gt2 FROM unc"))
def tree_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spread(spark, sf_dir)
    return s.select("target", "node_id", F.round("y_pred", 9).alias("y_pred"), *(F.round(c, 6).alias(c) for c in ("y_unc", "p_gt1", "p_gt2")))


@query(with_(L.LONG + _TREES, "SELECT target, count(*) AS n, round(min(y_pred), 6) AS lo, round(max(y_pred), 6) AS hi, round(avg(y_pred), 6) AS mean, round(avg(CAST(p_gt1 >= 0.5 AS DOUBLE)), 6) AS share_p50, round(avg(CAST(p_gt2 >= 0.5 AS DOUBLE)), 6) AS share_p80 FROM unc GROUP BY 1"))
def deploy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.avg((F.col(c) >= 0.5).cast("double"))
    return rounded(_spread(spark, sf_dir).groupBy("target").agg(F.count("*").alias("n"), F.min("y_pred").alias("lo"), F.max("y_pred").alias("hi"), F.avg("y_pred").alias("mean"), share("p_gt1").alias("share_p50"), share("p_gt2").alias("share_p80")))


@query(with_(L.FIELDS, "SELECT target, node_id, v, CAST(r AS INT) AS rank FROM (SELECT target, node_id, v, row_number() OVER (PARTITION BY target ORDER BY v DESC, node_id) AS r FROM fields) WHERE r <= 15"))
def top_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    f = L.fields(spark, sf_dir).withColumn("rank", F.row_number().over(W.partitionBy("target").orderBy(F.col("v").desc(), "node_id")))
    return f.filter("rank <= 15").select("target", "node_id", "v", "rank")


@query("SELECT kind, max_by(run, modified) AS run FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS kind, event_type || '_' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS run, strftime(ts, '%Y%m%d%H%M%S') || lpad(CAST(event_id AS VARCHAR), 8, '0') AS modified, event_id % 5 <> 0 AS complete FROM events) WHERE complete GROUP BY 1")
def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    number = F.lpad(F.col("event_id").cast("string"), 8, "0")
    r = e.select(
        F.when(F.col("event_id") % 3 == 0, "A").when(F.col("event_id") % 3 == 1, "B").otherwise("C").alias("kind"),
        F.concat_ws("_", "event_type", number).alias("run"),
        F.concat(F.date_format("ts", "yyyyMMddHHmmss"), number).alias("modified"),
        (F.col("event_id") % 5 != 0).alias("complete"),
    )
    return readers.newest_run(r)


@query(
    with_(
        L.CELLS + ", t AS (SELECT substr(sha1(CAST(node_id AS VARCHAR)), 1, 2) AS b, CAST('0x' || substr(sha1(node_id || '|' || n || '|' || block), 1, 12) AS BIGINT) AS p FROM cells), s AS (SELECT b, CAST(sum(p) AS VARCHAR) AS s FROM t GROUP BY 1)",
        "SELECT substr(sha1(string_agg(b || ':' || s, ',' ORDER BY b)), 1, 16) AS fingerprint FROM s",
    )
)
def data_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.fingerprint(L.cells(spark, sf_dir), ["node_id"], ["n", "block"])


@query(
    with_(
        L.SCORES + ", two AS (SELECT target, fold, config_id, score AS cv, CASE WHEN config_id % 5 = 0 THEN NULL ELSE round(-score * (config_id % 4), 6) END AS oob FROM scores)",
        "SELECT *, rank_cv = 1 AS selected_cv, rank_oob = 1 AS selected_oob FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target, fold ORDER BY cv DESC NULLS LAST, config_id) AS INT) AS rank_cv, CAST(row_number() OVER (PARTITION BY target, fold ORDER BY oob DESC NULLS LAST, config_id) AS INT) AS rank_oob FROM two)",
    )
)
def dual_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    oob = F.when(F.col("config_id") % 5 != 0, F.round(-F.col("score") * (F.col("config_id") % 4), 6))
    s = L.scores(spark, sf_dir).select("target", "fold", "config_id", F.col("score").alias("cv"), oob.alias("oob"))
    return reports.dual_selection(s, ["target", "fold"], ["cv", "oob"])


@query(with_(L.SCORES, "SELECT target, fold, config_id, a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY target, fold ORDER BY score DESC, config_id) AS r FROM scores WHERE a = 1) WHERE r = 1"))
def fixed_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.fixed_design(L.scores(spark, sf_dir), ["target", "fold"], F.col("a") == 1)


@query(with_(L.LONG + ", thin AS (SELECT * FROM long WHERE NOT (method = 'COL' AND node_id % 3 = 0) AND NOT (method = 'NBR' AND node_id % 5 = 0)), com AS (SELECT target, node_id FROM thin GROUP BY 1, 2 HAVING count(*) = 3)", f"SELECT 'native' AS support, target, method, {_ACC} FROM thin GROUP BY 2, 3 UNION ALL SELECT 'common', target, method, {_ACC} FROM thin SEMI JOIN com USING (target, node_id) GROUP BY 2, 3"))
def support_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    thin = L.long(spark, sf_dir).filter("not (method = 'COL' and node_id % 3 = 0) and not (method = 'NBR' and node_id % 5 = 0)")
    both = thin.groupBy("target", "node_id").agg(F.count("*").alias("c")).filter("c = 3").select("target", "node_id")
    native = metrics.scored(thin, KEYS).withColumn("support", F.lit("native"))
    common = metrics.scored(thin.join(both, ["target", "node_id"], "left_semi"), KEYS).withColumn("support", F.lit("common"))
    return rounded(native.unionByName(common))


@query(
    """WITH t AS (SELECT CAST(l_partkey % 24 AS INT) AS i, CAST(CAST(l_quantity AS INT) % 20 AS INT) AS j, CAST(l_linenumber AS INT) AS k, l_orderkey AS o, l_suppkey AS p, l_extendedprice AS v FROM lineitem)
    SELECT i, j, k, o, p, v, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY i, j, k ORDER BY o DESC, p DESC, v DESC) AS r, count(*) OVER (PARTITION BY i, j, k) AS n_rows FROM t) WHERE r = 1"""
)
def unique_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_partkey") % 24).cast("int").alias("i"), (F.col("l_quantity").cast("int") % 20).cast("int").alias("j"), F.col("l_linenumber").cast("int").alias("k"), F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("p"), F.col("l_extendedprice").alias("v")
    )
    return grid.unique_cells(t, ["o", "p", "v"])


# --- coherence -------------------------------------------------------------------------------

_NEAR = ", nb AS (SELECT f.target, f.node_id, f.v, g.v AS w FROM fields f, offsets o, fields g WHERE o.o <> 13 AND g.target = f.target AND g.i = f.i + o.a AND g.j = f.j + o.b AND g.k = f.k + o.c)"


@query(
    with_(
        L.FIELDS + "," + L.OFFSETS + _NEAR + ", z AS (SELECT target, abs((v - mid) / sd) AS z FROM (SELECT target, node_id, any_value(v) AS v, median(w) AS mid FROM nb GROUP BY 1, 2) JOIN (SELECT target, stddev_pop(v) AS sd FROM fields GROUP BY 1) USING (target))",
        "SELECT target, count(*) AS n_cells, round(avg(z), 6) AS roughness, round(100 * avg(CAST(z > 2 AS DOUBLE)), 6) AS spike2_pct, round(100 * avg(CAST(z > 3 AS DOUBLE)), 6) AS spike3_pct FROM z GROUP BY 1",
    )
)
def spike_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coherence.spikes(L.fields(spark, sf_dir).select("target", "i", "j", "k", "v"), ["target"]))


@query(
    with_(
        L.FIELDS + "," + L.OFFSETS + _NEAR + ", m AS (SELECT target, node_id, any_value(v) AS v, avg(w) AS near FROM nb GROUP BY 1, 2), st AS (SELECT target, avg(v) AS mu, stddev_pop(v) AS sd FROM fields GROUP BY 1)",
        "SELECT target, count(*) AS n_cells, round(100 * avg(CAST(sign(v - mu) <> sign(near - mu) AND abs((v - mu) / sd) > 1 AS DOUBLE)), 6) AS discordant_pct FROM m JOIN st USING (target) GROUP BY 1",
    )
)
def lisa_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coherence.discordance(L.fields(spark, sf_dir).select("target", "i", "j", "k", "v"), ["target"]))


_SUP = ", cuts AS (SELECT target, quantile_cont(v, 0.33) AS c1, quantile_cont(v, 0.67) AS c2 FROM fields GROUP BY 1), cf AS (SELECT f.*, CAST(v >= c1 AS INT) + CAST(v >= c2 AS INT) AS cls FROM fields f JOIN cuts USING (target)), sup AS (SELECT f.target, f.i, f.j, f.k, f.cls AS class, 1 + count(*) FILTER (g.cls = f.cls) AS support, count(g.cls) AS n_near FROM cf f CROSS JOIN offsets o LEFT JOIN cf g ON g.target = f.target AND g.i = f.i + o.a AND g.j = f.j + o.b AND g.k = f.k + o.c WHERE o.o <> 13 GROUP BY 1, 2, 3, 4, 5)"


def _support(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = L.fields(spark, sf_dir).join(F.broadcast(_cuts(spark, sf_dir)), "target")
    f = f.select("target", "i", "j", "k", coherence.classes(F.col("v"), [F.col("c1"), F.col("c2")]).alias("v"))
    return coherence.class_support(f, ["target"])


@query(with_(L.FIELDS + "," + L.OFFSETS + _SUP, "SELECT target, i, j, k, class, CAST(support AS INT) AS support, n_near FROM sup"))
def class_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _support(spark, sf_dir)


@query(
    with_(
        L.FIELDS + "," + L.OFFSETS + _SUP,
        "SELECT target, count(*) FILTER (n_near >= 8) AS n_tested, round(100.0 * count(*) FILTER (n_near >= 8 AND support < 5) / count(*) FILTER (n_near >= 8), 6) AS speck_pct, round(CASE WHEN count(*) FILTER (n_near = 26) > 0 THEN 100.0 * count(*) FILTER (n_near = 26 AND support < 5) / count(*) FILTER (n_near = 26) END, 6) AS speck_full_pct, round(100.0 * count(*) FILTER (n_near >= 8 AND support <= 4) / count(*) FILTER (n_near >= 8), 6) AS band_1_4, round(100.0 * count(*) FILTER (n_near >= 8 AND support BETWEEN 5 AND 13) / count(*) FILTER (n_near >= 8), 6) AS band_5_13, round(100.0 * count(*) FILTER (n_near >= 8 AND support >= 14) / count(*) FILTER (n_near >= 8), 6) AS band_14_27, median(support) FILTER (n_near >= 8) AS median_support FROM sup GROUP BY 1",
    )
)
def speck_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coherence.specks(_support(spark, sf_dir), ["target"]))


@query(with_(L.FIELDS + "," + L.OFFSETS + _SUP, "SELECT target, class, least, round(100.0 * count(*) FILTER (support < least) / count(*), 6) AS speck_pct FROM sup, (SELECT unnest(generate_series(2, 13))::INT AS least) WHERE n_near >= 8 GROUP BY 1, 2, 3"))
def speck_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _support(spark, sf_dir).filter("n_near >= 8").select("target", "class", "support", F.explode(F.sequence(F.lit(2), F.lit(13))).alias("least"))
    return rounded(s.groupBy("target", "class", "least").agg((100.0 * F.count_if(F.col("support") < F.col("least")) / F.count("*")).alias("speck_pct")))


def _components_sql(cutoffs: str, faces: bool) -> str:
    step = "abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1" if faces else "abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 AND a.node_id <> b.node_id"
    return f""",
lv AS ({cutoffs}),
above AS (SELECT l.target, l.level, f.node_id, f.i, f.j, f.k FROM fields f JOIN lv l ON l.target = f.target WHERE f.v >= l.cut),
edges AS (SELECT a.target, a.level, a.node_id AS p, b.node_id AS q FROM above a JOIN above b ON a.target = b.target AND a.level = b.level AND b.i BETWEEN a.i - 1 AND a.i + 1 AND {step}),
walk(target, level, node_id, label) AS (SELECT target, level, node_id, node_id FROM above UNION SELECT w.target, w.level, e.q, w.label FROM walk w JOIN edges e ON e.target = w.target AND e.level = w.level AND e.p = w.node_id WHERE w.label < e.q),
comp AS (SELECT target, level, node_id, min(label) AS label FROM walk GROUP BY 1, 2, 3),
sizes AS (SELECT target, level, label, count(*) AS size FROM comp GROUP BY 1, 2, 3)"""


def _levels(spark: SparkSession, sf_dir: str, qs: tuple[float, ...]) -> DataFrame:
    lit = F.array(*(F.lit(q) for q in qs))
    p = L.fields(spark, sf_dir).groupBy("target").agg(F.percentile("v", lit).alias("p"))
    return p.select("target", F.explode(F.arrays_zip(lit.alias("level"), "p")).alias("x")).select("target", "x.level", F.col("x.p").alias("cut"))


def _tree(spark: SparkSession, sf_dir: str, qs: tuple[float, ...], connect: int = 6, tile: int = 32) -> DataFrame:
    """The component tree of both fields at the quantiles qs, which name its levels."""
    cuts = _levels(spark, sf_dir, qs).groupBy("target").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    f = L.fields(spark, sf_dir).join(F.broadcast(cuts), "target")
    f = f.select("target", "i", "j", "k", coherence.levels_of(F.col("v"), [F.col("cuts")[n] for n in range(len(qs))]).alias("level"))
    names = F.array(*(F.lit(q) for q in qs))
    return coherence.component_tree(f, ["target"], len(qs), connect, tile).withColumn("level", names[F.col("level") - 1])


def _cut_sql(qs: tuple[float, ...]) -> str:
    return " UNION ALL ".join(f"SELECT target, CAST({q} AS DOUBLE) AS level, quantile_cont(v, {q}) AS cut FROM fields GROUP BY 1" for q in qs)


_STATS = "CAST(sum(size) AS BIGINT) AS n_above, count(*) AS n_components, count(*) FILTER (size >= 12) AS n_viable, max(size) AS largest, round(max(size) / sum(size), 6) AS largest_frac, count(*) FILTER (size = 1) AS singletons, round(coalesce(sum(size) FILTER (size < 12), 0) / sum(size), 6) AS frac_in_small, median(size) AS median_size"
_LEVELS = (0.65, 0.9)


@query("WITH RECURSIVE " + L.FIELDS + _components_sql(_cut_sql(_LEVELS), True) + f" SELECT target, level, {_STATS} FROM sizes GROUP BY 1, 2")
def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coherence.connectivity_stats(_tree(spark, sf_dir, _LEVELS), ["target", "level"]))


@query(ORACLES["connectivity"])
def connectivity_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from tiles of 8 x 8 x 8 cells, whose parts of the tree meet across their faces."""
    return rounded(coherence.connectivity_stats(_tree(spark, sf_dir, _LEVELS, tile=8), ["target", "level"]))


@query("WITH RECURSIVE " + L.FIELDS + _components_sql(_cut_sql((0.8, 0.9)), False) + " SELECT target, level, least, count(*) FILTER (size >= least) AS n_viable, round(coalesce(sum(size) FILTER (size < least), 0) / sum(size), 6) AS frac_in_small FROM sizes, (SELECT unnest([2, 5, 12, 20]) AS least) GROUP BY 1, 2, 3")
def size_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["target", "level"]
    s = _tree(spark, sf_dir, (0.8, 0.9), connect=26).withColumn("least", F.explode(F.array(*(F.lit(x) for x in (2, 5, 12, 20)))))
    small = F.sum(F.when(F.col("size") < F.col("least"), F.col("size")).otherwise(0)) / F.sum("size")
    return rounded(s.groupBy(*keys, "least").agg(F.count_if(F.col("size") >= F.col("least")).alias("n_viable"), small.alias("frac_in_small")))


@query(with_(L.FIELDS + f", lv AS ({_cut_sql((0.65, 0.9))})", "SELECT f.target, level, round(avg(CAST(v >= cut AS DOUBLE)), 6) AS share_above, round(cut, 6) AS cut FROM fields f JOIN lv ON lv.target = f.target GROUP BY f.target, level, cut"))
def share_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read off the tree that ``connectivity`` reads: the cells above a cut-off are those of its components."""
    above = _tree(spark, sf_dir, (0.65, 0.9)).groupBy("target", "level").agg(F.sum("size").alias("n"))
    whole = L.fields(spark, sf_dir).groupBy("target").agg(F.count("v").alias("all"))
    cuts = _levels(spark, sf_dir, (0.65, 0.9)).join(above, ["target", "level"], "left").join(whole, "target")
    return rounded(cuts.select("target", "level", "cut", (F.coalesce("n", F.lit(0)) / F.col("all")).alias("share_above")))


# --- covariance ------------------------------------------------------------------------------

MODEL = kriging.Covariance(tuple(map(tuple, _R)), (60.0, 40.0, 15.0), nugget=0.1, kind="exponential")
_H = "sqrt(" + " + ".join(f"power((({{dx}}) * {r[0]!r} + ({{dy}}) * {r[1]!r} + ({{dz}}) * {r[2]!r}) / {s!r}, 2)" for r, s in zip(_R, MODEL.ranges, strict=True)) + ")"
_H = _H.format(dx="a.x - b.x", dy="a.y - b.y", dz="a.z - b.z")


@query(with_(L.CELLS + _NODES, f"SELECT a.node_id AS a, b.node_id AS b, round(0.9 * exp(-{_H}) + CASE WHEN a.node_id = b.node_id THEN 0.1 + 1e-8 ELSE 0 END, 6) AS cov FROM nodes a, nodes b"))
def cov_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kriging.covariance_pairs(_nodes(spark, sf_dir), MODEL))


@query(with_(L.CELLS + _NODES, f"SELECT a.node_id, round(any_value(a.fe0) + sum(0.9 * exp(-{_H}) * (b.dtr - 25) / 10), 6) AS krig FROM cells a, nodes b GROUP BY 1"))
def krige_given_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _nodes(spark, sf_dir).withColumn("alpha", (F.col("dtr") - 25) / 10)
    return rounded(kriging.krige(L.cells(spark, sf_dir).withColumn("m", F.col("fe0")), samples, MODEL))


# the Matern kernel in a frame that dips by 85 degrees, where the second axis is taken from north
STEEP = kriging.Covariance(tuple(map(tuple, features.rotation_matrix(30.0, 85.0))), (45.0, 30.0, 12.0), nugget=0.2, kind="matern32")


def _frame_sql(azimuth: float, dip: float, ranges: tuple[float, float, float]) -> str:
    """The reduced lag of a and b from the angles alone: major by azimuth and dip, semi across it
    and the reference axis, minor across both."""
    return f"""(WITH m AS (SELECT sin(radians({azimuth})) * cos(radians({dip})) AS m1, cos(radians({azimuth})) * cos(radians({dip})) AS m2, -sin(radians({dip})) AS m3),
r AS (SELECT *, CASE WHEN abs(m3) > 0.99 THEN 1.0 ELSE 0.0 END AS r2, CASE WHEN abs(m3) > 0.99 THEN 0.0 ELSE 1.0 END AS r3 FROM m),
s AS (SELECT *, r2 * m3 - r3 * m2 AS u1, r3 * m1 AS u2, -r2 * m1 AS u3 FROM r),
t AS (SELECT *, u1 / sqrt(u1 * u1 + u2 * u2 + u3 * u3) AS s1, u2 / sqrt(u1 * u1 + u2 * u2 + u3 * u3) AS s2, u3 / sqrt(u1 * u1 + u2 * u2 + u3 * u3) AS s3 FROM s)
SELECT *, m2 * s3 - m3 * s2 AS n1, m3 * s1 - m1 * s3 AS n2, m1 * s2 - m2 * s1 AS n3 FROM t)"""


@query(
    with_(
        L.CELLS
        + _NODES
        + f", frame AS (SELECT * FROM {_frame_sql(30.0, 85.0, STEEP.ranges)}), pos AS (SELECT node_id, (x * m1 + y * m2 + z * m3) / 45.0 AS u, (x * s1 + y * s2 + z * s3) / 30.0 AS v, (x * n1 + y * n2 + z * n3) / 12.0 AS w FROM nodes, frame), h AS (SELECT a.node_id AS a, b.node_id AS b, sqrt(power(a.u - b.u, 2) + power(a.v - b.v, 2) + power(a.w - b.w, 2)) AS h FROM pos a, pos b)",
        "SELECT a, b, round(0.8 * (1 + sqrt(3.0) * h) * exp(-sqrt(3.0) * h) + CASE WHEN a = b THEN 0.2 + 1e-8 ELSE 0 END, 6) AS cov FROM h",
    )
)
def cov_matrix_steep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kriging.covariance_pairs(_nodes(spark, sf_dir), STEEP))


@query(
    with_(
        L.CELLS + f", frame AS (SELECT * FROM {_frame_sql(30.0, 85.0, STEEP.ranges)})",
        "SELECT node_id, round((x * m1 + y * m2 + z * m3) / 45.0, 6) AS u, round((x * s1 + y * s2 + z * s3) / 30.0, 6) AS v, round((x * n1 + y * n2 + z * n3) / 12.0, 6) AS w FROM cells, frame",
    )
)
def steep_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v, w = features.continuity_frame(features.rotation_matrix(30.0, 85.0), STEEP.ranges, F.col("x"), F.col("y"), F.col("z"))
    return rounded(L.cells(spark, sf_dir).select("node_id", u.alias("u"), v.alias("v"), w.alias("w")))
