"""Runs of several arms that can be taken up again.

The manifest is a folder with a table for each finished arm.  An arm is written aside and then renamed to its
place, which file systems do in one step, so an arm is there as a whole or not at all; whoever looks
reads finished arms only.  What is to do is an anti-join of the arms with the manifest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


class Manifest:
    """The finished arms under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _system(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def finished(self) -> DataFrame:
        """(arm) of the arms that are done."""
        fs, top = self._system(), self._path("done")
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return self.spark.createDataFrame([(n.removeprefix("arm="),) for n in names], "arm string")

    def commit(self, arm: str, rows: DataFrame) -> None:
        """Writes rows aside and makes them the arm's; an arm that is there already stays as it is."""
        aside = self._path(f"aside/{uuid.uuid4().hex}")
        rows.write.parquet(aside.toString())
        fs, place = self._system(), self._path(f"done/arm={arm}")
        fs.mkdirs(place.getParent())
        if fs.exists(place) or not fs.rename(aside, place):
            fs.delete(aside, True)

    def run(self, arms: DataFrame, compute: Callable[[Row], DataFrame], order: str = "arm") -> list[str]:
        """Computes the arms (a row each, with a column ``arm``) that aren't finished, one after the other, and
        names them.  What compute raises ends the run; the arms before it stay."""
        todo = arms.join(F.broadcast(self.finished()), "arm", "left_anti").orderBy(order).collect()  # a design has few arms
        for arm in todo:
            self.commit(arm["arm"], compute(arm))
        return [arm["arm"] for arm in todo]

    def rows(self) -> DataFrame:
        """The rows of all finished arms, with ``arm``."""
        return self.spark.read.option("basePath", f"{self.root}/done").option("mergeSchema", "true").parquet(f"{self.root}/done")
