"""The lattice view of a stream of lines.

The aggregation is that of the batch view; its state has a row per cell of the grid, so it
is bounded without a watermark.  Each trigger replaces the table of cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.lattice import cells_of


def read_lines(spark: SparkSession, path: str, files_a_trigger: int = 1) -> DataFrame:
    """Parquet files of order lines as they arrive in a folder."""
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def keep_cells(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the cells of all lines so far to ``path`` after each trigger; a trigger that is
    run again writes the same table."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return cells_of(lines).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).start()
