"""Trees grown by aggregates, with the DuckDB text of their levels, and tuning over a full grid."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import features, grid, growth, metrics, reports
from ..operators.lineage import settle, shared_dir
from ..operators.runs import Manifest
from . import lattice as L
from .models import _samples
from .queries import _NODES, COV, query, rounded, with_

FEATURES = (*COV, "x", "y", "z")
LEAST = 3


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, fold, x, dtr, magnetic) of the sampled nodes, x their FEATURES; values settled to six digits."""
    n = L.cells(spark, sf_dir).filter("dtr is not null and valid")
    x = F.array(*(L.settled(F.col(c)) for c in COV), *(F.col(a) for a in "xyz"))
    return n.select(F.col("node_id").alias("sample"), "fold", x.alias("x"), *(L.settled(F.col(c)).alias(c) for c in ("dtr", "magnetic")))


def _grown(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    """One tree for each target and outer fold, on the samples of the other folds; job = target * 5 + fold."""
    rows, ends = growth.binned(_places(spark, sf_dir))
    two = F.array(F.struct(F.lit(0).alias("t"), F.col("dtr").alias("y")), F.struct(F.lit(1).alias("t"), F.col("magnetic").alias("y")))
    out = rows.select("fold", "bins", F.explode(two).alias("p"), F.lit(0).alias("tree"), F.lit(1).cast("long").alias("w"))
    out = out.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(L.FOLDS - 1)))).filter("o <> fold")
    members = out.select((F.col("p.t") * L.FOLDS + F.col("o")).cast("long").alias("job"), "tree", "w", F.col("p.y").alias("y"), "bins")
    jobs = spark.createDataFrame([(j, depth, LEAST, None) for j in range(2 * L.FOLDS)], "job long, depth int, least int, mtry int")
    return growth.grow(members, jobs, ends)


def _levels_sql(depth: int) -> str:
    out = (
        L.CELLS
        + _NODES
        + """,
places AS (SELECT node_id AS sample, fold, x, y AS north, z, """
        + ", ".join(f"floor({c} * 1e6 + 0.377) / 1e6 AS {c}" for c in (*COV, "dtr", "magnetic"))
        + " FROM nodes),\nfeat AS ("
        + " UNION ALL ".join(f"SELECT sample, {n} AS f, {'north' if c == 'y' else c} AS v FROM places" for n, c in enumerate(FEATURES))
        + f"""),
codes AS (SELECT f, v, CASE WHEN n <= {growth.BINS} THEN r ELSE r * {growth.BINS} // n END AS bin FROM (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY f) AS n FROM (SELECT DISTINCT f, v FROM feat))),
b AS (SELECT sample, f, bin FROM feat JOIN codes USING (f, v)),
ends AS (SELECT f, bin, min(v) AS lo, max(v) AS hi FROM codes GROUP BY 1, 2),
cuts AS (SELECT f, bin, (hi + lead(lo) OVER (PARTITION BY f ORDER BY bin)) / 2 AS cut FROM ends),
m0 AS (SELECT t.target, o.o, p.sample, CASE t.target WHEN 'DTR' THEN dtr ELSE magnetic END AS y, 0 AS node FROM places p, (SELECT unnest(['DTR', 'MAG']) AS target) t, (SELECT unnest([0, 1, 2, 3, 4]) AS o) o WHERE p.fold <> o.o)"""
    )
    for n in range(depth):
        out += f""",
h{n} AS (SELECT target, o, node, f, bin, count(*) AS w, sum(y) AS s FROM m{n} JOIN b USING (sample) GROUP BY ALL),
c{n} AS (SELECT *, sum(w) OVER u AS lw, sum(s) OVER u AS ls, sum(w) OVER a AS tw, sum(s) OVER a AS ts FROM h{n} WINDOW u AS (PARTITION BY target, o, node, f ORDER BY bin), a AS (PARTITION BY target, o, node, f)),
g{n} AS (SELECT *, round(power(ls, 2) / lw + power(ts - ls, 2) / (tw - lw) - power(ts, 2) / tw, {growth.DIGITS}) AS gain FROM c{n} WHERE lw >= {LEAST} AND tw - lw >= {LEAST}),
s{n} AS (SELECT * FROM (SELECT target, o, node, f, bin, gain, row_number() OVER (PARTITION BY target, o, node ORDER BY gain DESC, f, bin) AS r FROM g{n} WHERE gain >= 1e-6) WHERE r = 1),
m{n + 1} AS (SELECT m.target, m.o, m.sample, m.y, 2 * m.node + CASE WHEN b.bin > s.bin THEN 2 ELSE 1 END AS node FROM m{n} m JOIN s{n} s USING (target, o, node) JOIN b ON b.sample = m.sample AND b.f = s.f),
n{n} AS (SELECT target, o, node, count(*) AS n, avg(y) AS value FROM m{n} GROUP BY ALL)"""
    return out + f",\nn{depth} AS (SELECT target, o, node, count(*) AS n, avg(y) AS value FROM m{depth} GROUP BY ALL)"


_NAMES = "CASE s.f " + " ".join(f"WHEN {n} THEN '{c}'" for n, c in enumerate(FEATURES)) + " END AS feature"


def _node_sql(n: int) -> str:
    return f"SELECT target, o AS fold, CAST(node AS BIGINT) AS node, CAST(n AS DOUBLE) AS n, round(value, 6) AS value, {_NAMES}, round(cut, 3) AS cut, round(gain, 4) AS gain FROM n{n} LEFT JOIN s{n} s USING (target, o, node) LEFT JOIN cuts USING (f, bin)"


def _named(nodes: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, FEATURES))
    out = nodes.select(F.when(F.col("job") < L.FOLDS, "DTR").otherwise("MAG").alias("target"), (F.col("job") % L.FOLDS).cast("int").alias("fold"), "node", "n", "value", names[F.col("feature")].alias("feature"), F.round("cut", 3).alias("cut"), F.round("gain", 4).alias("gain"))
    return rounded(out)


@query(with_(_levels_sql(1), _node_sql(0)))
def tree_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of the tree of every target and fold with its split."""
    return _named(_grown(spark, sf_dir, 1).filter("node = 0"))


@query(with_(_levels_sql(2), f"{_node_sql(0)} UNION ALL {_node_sql(1)} UNION ALL SELECT target, o, CAST(node AS BIGINT), CAST(n AS DOUBLE), round(value, 6), NULL, NULL, NULL FROM n2"))
def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of trees of depth two."""
    return _named(_grown(spark, sf_dir, 2))


DEPTHS, LEASTS, MTRYS = (2, 4, 6), (2, 4, 8), (11, 45, 90)
TREES = 2


@query()
def tune_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """27 configurations scored on the inner folds of every outer fold, for both targets: all their trees grow
    together.  A pair of held-out folds has one training set, whichever of the two is the outer one, and a
    depth is read off the deepest trees, so 9 growths of 20 sets score all of them."""
    s = settle(_samples(spark, sf_dir))
    rows, ends = growth.binned(s.select(F.col("node_id").alias("sample"), F.col("features").alias("x")).dropDuplicates(["sample"]))
    rows = settle(rows.select("sample", "bins"))
    pairs = [(a, b) for a in range(L.FOLDS) for b in range(a + 1, L.FOLDS)]
    grids = [(least, mtry) for least in LEASTS for mtry in MTRYS]
    cases = [(t, a, b, g) for t in ("DTR", "MAG") for a, b in pairs for g in range(len(grids))]
    jobs = spark.createDataFrame([(j, t, a, b, g, max(DEPTHS), *grids[g]) for j, (t, a, b, g) in enumerate(cases)], "job long, target string, a int, b int, g int, depth int, least int, mtry int")
    sets = F.broadcast(jobs.select("job", "target", "a", "b"))  # a row for each case of a design
    known = s.select(F.col("node_id").alias("sample"), "target", "fold", "y").join(sets, "target")
    held_out = (F.col("fold") == F.col("a")) | (F.col("fold") == F.col("b"))
    drawn = growth.bootstrap(known.filter(~held_out).select("job", "sample", "y"), TREES, seed=123)
    nodes = settle(growth.grow(drawn.join(rows, "sample").select("job", "tree", "w", "y", "bins"), jobs.select("job", "depth", "least", "mtry"), ends, seed=123))
    asked = known.filter(held_out).select("job", "sample").join(rows, "sample")
    mean = growth.predict(asked, nodes, DEPTHS).groupBy("job", "sample", "depth").agg(F.avg("value").alias("p"))
    scored = mean.join(known.filter(held_out).select("job", "sample", "target", "fold", "y", "a", "b"), ["job", "sample"]).join(F.broadcast(jobs.select("job", "g")), "job")
    # the outer fold is the one of the pair that the sample isn't in
    scored = scored.withColumn("outer", F.when(F.col("fold") == F.col("a"), F.col("b")).otherwise(F.col("a")))
    depth = F.array_position(F.array(*map(F.lit, DEPTHS)), F.col("depth")).cast("int") - 1
    score = 1 - F.sum((F.col("y") - F.col("p")) ** 2) / F.greatest(F.var_pop("y") * F.count("y"), F.lit(1e-300))
    out = scored.groupBy("target", F.col("outer").alias("fold"), (depth * len(grids) + F.col("g")).alias("config_id")).agg(F.count("*").alias("n"), score.alias("score"))
    return reports.rank_configs(rounded(out), ["target", "fold"])


#: The levels of the sensitivity factorial; features that a split looks at are shares of all of them.
SWEEP_DEPTHS, SWEEP_LEASTS = (2, 3, 4, 6, 8, 10, 14), (1, 2, 4, 8, 16, 30, 50)
SWEEP_MTRYS, SWEEP_SHARES = (("sqrt", 0.0), ("third", 1 / 3), ("0.5", 0.5), ("0.75", 0.75), ("all", 1.0)), (0.5, 0.7, 1.0)


def _cross_validated(spark: SparkSession, sf_dir: str, cases: list[tuple[int, int, float]], depth: int, trees: int, depths: tuple[int, ...]) -> DataFrame:
    """(case, fold, sample, y, tree, depth, value): out-of-fold predictions for DTR of every tree of every case, a case being
    (least, mtry as a count, share of samples drawn)."""
    s = settle(_samples(spark, sf_dir).filter("target = 'DTR'").select(F.col("node_id").alias("sample"), "fold", "y", F.col("features").alias("x")))
    rows, ends = growth.binned(s)
    rows = settle(rows)
    jobs = [(c * L.FOLDS + f, c, f, depth, least, mtry, share) for c, (least, mtry, share) in enumerate(cases) for f in range(L.FOLDS)]
    jobs = spark.createDataFrame(jobs, "job long, c int, o int, depth int, least int, mtry int, share double")
    drawn = None
    for share in sorted({x[2] for x in cases}):
        known = rows.select("sample", "fold", "y").join(F.broadcast(jobs.filter(F.col("share") == share).select("job", "o")), F.col("o") != F.col("fold"))
        part = growth.bootstrap(known.select("job", "sample", "y"), trees, seed=42, share=share)
        drawn = part if drawn is None else drawn.unionByName(part)
    members = drawn.join(rows.select("sample", "bins"), "sample").select("job", "tree", "w", "y", "bins")
    nodes = settle(growth.grow(members, jobs.select("job", "depth", "least", "mtry"), ends, seed=42))
    asked = rows.join(F.broadcast(jobs.select("job", "o")), F.col("o") == F.col("fold")).select("job", "sample", "bins")
    out = growth.predict(asked, nodes, depths)
    return out.join(F.broadcast(jobs.select("job", "c")), "job").join(rows.select("sample", "fold", "y"), "sample").select(F.col("c").alias("case"), "fold", "sample", "y", "tree", "depth", "value")


def _r2(y: str, p: str):
    return 1 - F.sum((F.col(y) - F.col(p)) ** 2) / F.greatest(F.var_pop(y) * F.count(y), F.lit(1e-300))


@query()
def sensitivity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """735 configurations without inner tuning: pooled R2 over the folds and the mean of the folds' R2.  Depths are read off the
    deepest trees, so 105 growths of five folds, one tree each, score all of them."""
    wide = 27 * 5
    count = {n: int(wide**0.5) if n == "sqrt" else max(1, int(wide * x)) for n, x in SWEEP_MTRYS}
    cases = [(least, count[name], share) for least in SWEEP_LEASTS for name, _ in SWEEP_MTRYS for share in SWEEP_SHARES]
    names = [(c, least, name, share) for c, (least, name, share) in enumerate((a, n, s) for a in SWEEP_LEASTS for n, _ in SWEEP_MTRYS for s in SWEEP_SHARES)]
    p = _cross_validated(spark, sf_dir, cases, max(SWEEP_DEPTHS), 1, SWEEP_DEPTHS)
    per = p.groupBy("case", "depth", "fold").agg(_r2("y", "value").alias("r2")).groupBy("case", "depth").agg(F.avg("r2").alias("r2_folds"))
    pooled = p.groupBy("case", "depth").agg(F.count("*").alias("n"), _r2("y", "value").alias("r2"))
    labels = spark.createDataFrame(names, "case int, least int, mtry string, share double")
    return rounded(pooled.join(per, ["case", "depth"]).join(F.broadcast(labels), "case").select("depth", "least", "mtry", "share", "n", "r2", "r2_folds"))


CURVE = (3, 5, 8, 10, 15, 20, 30, 50, 75)


@query()
def sensitivity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over the folds by the number of trees: the first of 75 trees that grow once."""
    p = _cross_validated(spark, sf_dir, [(3, 45, 1.0)], 6, max(CURVE), (6,))
    first = [F.avg(F.when(F.col("tree") < n, F.col("value"))) for n in CURVE]
    mean = p.groupBy("sample", "y").agg(F.array(*(F.struct(F.lit(n).alias("trees"), m.alias("y_pred")) for n, m in zip(CURVE, first, strict=True))).alias("m"))
    return rounded(metrics.scored(mean.select(F.col("y").alias("y_true"), F.explode("m").alias("m")).select("y_true", "m.trees", "m.y_pred"), ["trees"]))


#: The arms of the ablation: rotations and oriented statistics, all four at k = 3, both corners at k = 5.
ARMS = [("local_k3", 1, 1, 3), ("local_aug_k3", 1, 0, 3), ("local_aniso_k3", 0, 1, 3), ("local_plain_k3", 0, 0, 3), ("local_k5", 1, 1, 5), ("local_plain_k5", 0, 0, 5)]
ARM_TREES, ARM_DEPTH = 2, 2


def arm_scores(spark: SparkSession, sf_dir: str, arm: Row) -> DataFrame:
    """(aug, aniso, kernel, target, fold, r2) of a forest with an arm's features on every fold of both targets.  With
    rotations each draw takes one of a pattern's four turns and a prediction is the mean over them."""
    k = arm["kernel"]
    p = grid.fill_idw(grid.accepted(grid.window_patterns(L.cells(spark, sf_dir), COV, L.DIMS, k), k), COV, k, L.CELL)
    known = L.cells(spark, sf_dir).filter("dtr is not null and magnetic is not null").select("i", "j", "k", F.col("node_id").alias("sample"), "fold", "dtr", "magnetic")
    p = settle(grid.flatten_patterns(p.join(known, ["i", "j", "k"]), COV).select("sample", "fold", "dtr", "magnetic", "filled", "features"))  # training rows only
    static = []
    if arm["aniso"]:
        pack = features.decay_pack(k, L.CELL, features.rotation_matrix(30.0, 20.0), (20.0, 10.0, 5.0))
        for c in COV:  # written one by one, as the expressions of a covariate are long
            p = settle(features.oriented_stats(p, F.expr(f"transform(filled, v -> v.{c})"), pack, c))
            static += [f"{c}_{part}_{m}" for part in ("all", "major", "semi", "minor") for m in ("mean", "var")]
    p = p.withColumn("static", F.array(*map(F.col, static)).cast("array<double>")).drop("filled")
    turned = features.rotate(p, "features", k) if arm["aug"] else p.withColumn("turn", F.lit(0))
    turns = 4 if arm["aug"] else 1
    rows, ends = growth.binned(turned.select("sample", "turn", "fold", "dtr", "magnetic", F.concat("features", "static").alias("x")))
    rows = settle(rows)
    two = F.array(F.struct(F.lit(0).alias("t"), F.col("dtr").alias("y")), F.struct(F.lit(1).alias("t"), F.col("magnetic").alias("y")))
    cases = rows.filter("turn = 0").select("sample", "fold", F.explode(two).alias("p")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(L.FOLDS - 1))))
    cases = cases.select("sample", "fold", "o", F.col("p.y").alias("y"), (F.col("p.t") * L.FOLDS + F.col("o")).cast("long").alias("job"))
    drawn = growth.bootstrap(cases.filter("fold <> o"), ARM_TREES, seed=777).withColumn("turn", F.pmod(F.xxhash64("job", "tree", "sample"), F.lit(turns)).cast("int"))
    members = drawn.join(rows.select("sample", "turn", "bins"), ["sample", "turn"]).select("job", "tree", "w", "y", "bins")
    width = rows.agg(F.max(F.size("bins"))).first()[0]
    jobs = spark.createDataFrame([(j, ARM_DEPTH, LEAST, width // 3) for j in range(2 * L.FOLDS)], "job long, depth int, least int, mtry int")
    nodes = settle(growth.grow(members, jobs, ends, seed=777))
    asked = cases.filter("fold = o").join(rows.select("sample", "bins"), "sample")
    mean = growth.predict(asked.select("job", "sample", "bins"), nodes).groupBy("job", "sample").agg(F.avg("value").alias("y_pred"))
    long = cases.filter("fold = o").select("job", "sample", F.col("y").alias("y_true")).join(mean, ["job", "sample"])
    out = metrics.scored(long, ["job"])
    factors = [F.lit(arm[c]).alias(c) for c in ("aug", "aniso", "kernel")]
    return out.select(*factors, F.when(F.col("job") < L.FOLDS, "DTR").otherwise("MAG").alias("target"), (F.col("job") % L.FOLDS).cast("int").alias("fold"), "n", "r2")


@query()
def ablation_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired effects of rotations, of oriented statistics and of the window's size over six arms, which a manifest
    keeps as they finish."""
    runs = Manifest(spark, f"{shared_dir(spark)}/ablation-{uuid.uuid4().hex}")
    runs.run(spark.createDataFrame(ARMS, "arm string, aug int, aniso int, kernel int"), lambda arm: arm_scores(spark, sf_dir, arm))
    rows = runs.rows()
    k3 = rows.filter("kernel = 3")
    out = reports.paired_effects(k3, "aug", 0, 1, ["target", "fold", "aniso"], "r2")
    out = out.unionByName(reports.paired_effects(k3, "aniso", 0, 1, ["target", "fold", "aug"], "r2"))
    return rounded(out.unionByName(reports.paired_effects(rows, "kernel", 3, 5, ["target", "fold", "aug", "aniso"], "r2")))
