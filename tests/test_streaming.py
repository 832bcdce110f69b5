from pyspark.sql import functions as F

from stratloom.plans import lattice
from stratloom.streaming import cells


def test_cells_of_a_stream_equal_the_batch(spark, sf_dir, tmp_path):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    lines.repartition(3).write.parquet(str(tmp_path / "in"))
    q = cells.keep_cells(cells.read_lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.node_id: (r.n, r.fe0, r.dtr) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.node_id: (r.n, r.fe0, r.dtr) for r in lattice.cells(spark, sf_dir).collect()}
    assert got == want and len(got) > 1000
