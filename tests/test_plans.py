"""Plans have the shape that scale needs: pruned scans, no products of cells, few exchanges."""

from pyspark.sql import functions as F

from stratloom.operators import folds, grid, joins
from stratloom.plans import lattice


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_what_cells_need(spark, sf_dir):
    text = plan(lattice.cells(spark, sf_dir))
    assert "l_partkey" in text and "l_orderkey" not in text and "l_suppkey" not in text
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text


def test_filters_reach_the_scan(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_quantity > 40")
    assert "GreaterThan(l_quantity" in plan(lattice.cells_of(lines))


def test_stencils_have_no_join(spark):
    df = spark.range(1000).select(*((F.col("id") % n).cast("int").alias(c) for c, n in (("i", 10), ("j", 7), ("k", 5))), F.rand(1).alias("v")).dropDuplicates(["i", "j", "k"])
    text = plan(grid.neighbourhood(df, "v", grid.cube_offsets(3, centre=False), {"m": F.avg("v")}))
    assert "Join" not in text and "partial_avg" in text


def test_radius_searches_are_equi_joins(spark, sf_dir):
    c = lattice.cells(spark, sf_dir)
    for df in (folds.buffer_nodes(c, (5.0, 5.0, 2.0)), joins.tolerance_matches(c, c.withColumnRenamed("node_id", "other_id"), "node_id", "other_id")):
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text
