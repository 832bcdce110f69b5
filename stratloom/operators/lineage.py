"""Cutting the lineage of iterative plans by written tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names and all executors share; only where it is unset
    and the master is local a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="stratloom-")
    return _own["dir"]


def settle(df: DataFrame) -> DataFrame:
    """The rows, written and read again.  Unlike a checkpoint the result has the size of its files
    for an estimate; estimates of plans that join what they have written multiply from round to round.
    The folder is the caller's to clean."""
    path, schema = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
