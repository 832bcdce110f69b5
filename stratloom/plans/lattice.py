"""The lattice view: order lines as cells of a 24 x 20 x 12 grid, and methods that predict it.

Both forms are here, the Spark plan and the DuckDB text that must agree with it.  Lines are
reduced to cells in one aggregation with partial sums, so what follows has the size of the
grid, whatever the number of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.grid import cube_offsets, neighbourhood

DIMS = (24, 20, 12)
CELL = (5.0, 5.0, 2.0)
COVARIATES = ("fe", "feo", "magsus", "s")
FOLDS = 5
BLOCKS = (3, 4, 2)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cell that has lines: indices, node_id, coordinates, raw values, covariates (null
    in voids and outside of the envelope) and responses (null off the drill traces)."""
    return cells_of(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def cells_of(line: DataFrame) -> DataFrame:
    """The cells of a table or a stream of lines."""
    exact = lambda c: F.col(c).cast("decimal(18,2)")
    back = F.col("l_returnflag") == "R"
    grid = line.groupBy(
        (F.col("l_partkey") % 24).cast("int").alias("i"),
        (F.col("l_quantity").cast("int") % 20).cast("int").alias("j"),
        (F.month("l_shipdate") - 1).cast("int").alias("k"),
    ).agg(
        F.count("*").alias("n"),
        *(F.sum(exact(c)).cast("double").alias(a) for a, c in (("_q", "l_quantity"), ("_p", "l_extendedprice"), ("_d", "l_discount"), ("_t", "l_tax"))),
        F.count_if(back).alias("_r"),
        F.sum(F.when(back, exact("l_quantity"))).cast("double").alias("_rq"),
        F.sum(F.when(back, exact("l_extendedprice"))).cast("double").alias("_rp"),
    )
    valid = ((7 * F.col("i") + 11 * F.col("j") + 13 * F.col("k")) % 10 != 0) & F.expr("25 * (2 * i - 23) * (2 * i - 23) + 36 * (2 * j - 19) * (2 * j - 19) + 100 * (2 * k - 11) * (2 * k - 11) <= 12000")
    trace = (5 * F.col("i") + 3 * F.col("j")) % 7 == 0
    raw = {"fe0": "_q", "feo0": "_p", "magsus0": "_d", "s0": "_t"}
    grid = grid.withColumns({a: F.col(c) / F.col("n") for a, c in raw.items()})
    return grid.select(
        "i",
        "j",
        "k",
        ((F.col("i") * 20 + F.col("j")) * 12 + F.col("k")).cast("long").alias("node_id"),
        (F.col("i") * 5.0).alias("x"),
        (F.col("j") * 5.0).alias("y"),
        (F.col("k") * 2.0).alias("z"),
        "n",
        *raw,
        valid.alias("valid"),
        *(F.when(valid, F.col(f"{c}0")).alias(c) for c in COVARIATES),
        F.when(trace & (F.col("_r") > 0), F.col("_rq") / F.col("_r")).alias("dtr"),
        F.when(trace & (F.col("_r") > 0), F.col("_rp") / F.col("_r") / 1000).alias("magnetic"),
        block().alias("block"),
        (block() * 7 % FOLDS).cast("int").alias("fold"),
    )


def block():
    return F.expr("((i div 8) * 4 + (j div 5)) * 2 + (k div 6)").cast("int")


CELLS = """
grid AS (
  SELECT CAST(l_partkey % 24 AS INT) AS i, CAST(CAST(l_quantity AS INT) % 20 AS INT) AS j, CAST(month(l_shipdate) - 1 AS INT) AS k, count(*) AS n,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS fe0, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS feo0,
    CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS magsus0, CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS s0,
    count(*) FILTER (l_returnflag = 'R') AS r,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (l_returnflag = 'R') AS DOUBLE) AS rq, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag = 'R') AS DOUBLE) AS rp
  FROM lineitem GROUP BY 1, 2, 3),
marked AS (
  SELECT *, (7 * i + 11 * j + 13 * k) % 10 <> 0 AND 25 * (2 * i - 23) * (2 * i - 23) + 36 * (2 * j - 19) * (2 * j - 19) + 100 * (2 * k - 11) * (2 * k - 11) <= 12000 AS valid,
    (5 * i + 3 * j) % 7 = 0 AND r > 0 AS traced, ((i // 8) * 4 + (j // 5)) * 2 + (k // 6) AS block FROM grid),
cells AS (
  SELECT i, j, k, CAST((i * 20 + j) * 12 + k AS BIGINT) AS node_id, CAST(i * 5.0 AS DOUBLE) AS x, CAST(j * 5.0 AS DOUBLE) AS y, CAST(k * 2.0 AS DOUBLE) AS z, n, fe0, feo0, magsus0, s0, valid,
    CASE WHEN valid THEN fe0 END AS fe, CASE WHEN valid THEN feo0 END AS feo, CASE WHEN valid THEN magsus0 END AS magsus, CASE WHEN valid THEN s0 END AS s,
    CASE WHEN traced THEN rq / r END AS dtr, CASE WHEN traced THEN rp / r / 1000 END AS magnetic, block, block * 7 % 5 AS fold FROM marked)"""

#: The 27 offsets of a window with their places.
OFFSETS = """
offsets AS (
  SELECT a, b, c, ((a + 1) * 3 + b + 1) * 3 + c + 1 AS o FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b), (SELECT unnest([-1, 0, 1]) AS c))"""


def settled(v):
    """Six digits, cut off where the means of whole numbers of values have no ties."""
    return F.floor(v * 1e6 + 0.377).cast("double") / 1e6


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, node_id, i, j, k, x, y, z, fold, v): two fields over all cells."""
    pair = F.array(F.struct(F.lit("DTR").alias("target"), settled(F.col("feo0") / 1000).alias("v")), F.struct(F.lit("MAG").alias("target"), settled(F.col("fe0")).alias("v")))
    return cells(spark, sf_dir).select("node_id", "i", "j", "k", "x", "y", "z", "fold", F.explode(pair).alias("t")).select("t.target", "node_id", "i", "j", "k", "x", "y", "z", "fold", "t.v")


FIELDS = (
    CELLS
    + """,
fields AS (
  SELECT 'DTR' AS target, node_id, i, j, k, x, y, z, fold, floor(feo0 / 1000 * 1e6 + 0.377) / 1e6 AS v FROM cells
  UNION ALL SELECT 'MAG', node_id, i, j, k, x, y, z, fold, floor(fe0 * 1e6 + 0.377) / 1e6 FROM cells)"""
)


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long prediction table of three methods: the mean of the neighbours (NBR), of the rest of
    the column (COL) and of all other folds (BLK)."""
    f = fields(spark, sf_dir)
    near = [
        neighbourhood(f.filter(F.col("target") == t).select("i", "j", "k", "v"), "v", cube_offsets(3, centre=False), {"NBR": F.avg("v")}).withColumn("target", F.lit(t)) for t in ("DTR", "MAG")
    ]
    near = near[0].unionByName(near[1]).select("target", "i", "j", "k", "NBR")
    column, whole, fold = W.partitionBy("target", "i", "j"), W.partitionBy("target"), W.partitionBy("target", "fold")
    sums = f.groupBy("target", "fold").agg(F.sum("v").alias("_fs"), F.count("*").alias("_fn"))
    sums = sums.withColumns({"_as": F.sum("_fs").over(whole), "_an": F.sum("_fn").over(whole)})
    rest = f.join(F.broadcast(sums), ["target", "fold"]).withColumn("BLK", (F.col("_as") - F.col("_fs")) / F.nullif(F.col("_an") - F.col("_fn"), F.lit(0)))
    rest = rest.withColumn("COL", (F.sum("v").over(column) - F.col("v")) / F.nullif(F.count("*").over(column) - 1, F.lit(0)))
    wide = rest.join(near, ["target", "i", "j", "k"], "left")
    methods = F.array(*(F.struct(F.lit(m).alias("method"), settled(F.col(m)).alias("y_pred")) for m in ("BLK", "COL", "NBR")))
    out = wide.select("target", "node_id", "i", "j", "k", "x", "y", "z", "fold", F.col("v").alias("y_true"), F.explode(methods).alias("m"))
    return out.select("target", "node_id", "i", "j", "k", "x", "y", "z", "fold", "y_true", "m.method", "m.y_pred").filter("y_pred is not null")


LONG = (
    FIELDS
    + ","
    + OFFSETS
    + """,
near AS (
  SELECT f.target, f.node_id, avg(g.v) AS nbr FROM fields f, offsets o, fields g
  WHERE o.o <> 13 AND g.target = f.target AND g.i = f.i + o.a AND g.j = f.j + o.b AND g.k = f.k + o.c GROUP BY 1, 2),
wide AS (
  SELECT f.*, n.nbr, (sum(v) OVER (PARTITION BY f.target, i, j) - v) / nullif(count(*) OVER (PARTITION BY f.target, i, j) - 1, 0) AS col,
    (sum(v) OVER (PARTITION BY f.target) - sum(v) OVER (PARTITION BY f.target, fold)) / nullif(count(*) OVER (PARTITION BY f.target) - count(*) OVER (PARTITION BY f.target, fold), 0) AS blk
  FROM fields f LEFT JOIN near n ON n.target = f.target AND n.node_id = f.node_id),
long AS (
  SELECT target, node_id, i, j, k, x, y, z, fold, v AS y_true, method, floor(p * 1e6 + 0.377) / 1e6 AS y_pred FROM (
    SELECT *, 'NBR' AS method, nbr AS p FROM wide UNION ALL SELECT *, 'COL', col FROM wide UNION ALL SELECT *, 'BLK', blk FROM wide) WHERE p IS NOT NULL)"""
)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, fold, config_id, a, b, score): twelve scalings of a method stand for configurations."""
    l = long(spark, sf_dir).filter("method = 'NBR'")
    out = l.select("target", "fold", "y_true", "y_pred", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("config_id"))
    out = out.groupBy("target", "fold", "config_id").agg(F.round(-F.avg(F.abs(F.col("y_true") - F.col("y_pred") * (0.94 + 0.01 * F.col("config_id")))), 6).alias("score"))
    return out.select("target", "fold", "config_id", (F.col("config_id") % 3).alias("a"), F.expr("config_id div 3").cast("int").alias("b"), "score")


SCORES = (
    LONG
    + """,
scores AS (
  SELECT target, fold, c AS config_id, c % 3 AS a, c // 3 AS b, round(-avg(abs(y_true - y_pred * (CAST(0.94 AS DOUBLE) + CAST(0.01 AS DOUBLE) * c))), 6) AS score
  FROM long, (SELECT unnest(generate_series(0, 11))::INT AS c) WHERE method = 'NBR' GROUP BY 1, 2, 3)"""
)
