"""Written tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset and the master is local a
    temporary folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="stratloom-")
    return _own["dir"]


class Workspace:
    """Tables of one call.  ``save`` writes and rereads, so that a lost executor costs the
    rereading of files and never the recomputation of a long lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self._paths: dict[int, str] = {}

    def save(self, df: DataFrame, tag: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{tag}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            path = self._paths.pop(id(df), None)
            if path:
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


    def release(self) -> None:
        """Let go of the shuffle files of plans that nothing refers to any more, which otherwise stay on
        the executors' disks until the driver happens to collect its garbage.  The listeners
        of a job let go of its plan a little after its end."""
        for _ in range(2):
            time.sleep(0.5)
            gc.collect()
            self.spark._jvm.System.gc()
        _release()


def settle(spark: SparkSession) -> None:
    """Executors collect their garbage, on which their heaps shrink to what is in use.  A heap that a finished
    step has filled otherwise keeps its size, which the Python workers of the next step then lack."""
    n = spark.sparkContext.defaultParallelism  # a task for each core, so that each executor has some
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') as done").collect()


ROWS_A_BATCH = 1000
MOST_IDS = 2_000_000


def ids_side(ids: DataFrame) -> DataFrame:
    """One column of ids as a side of a join with texts: counted (so let it be a written table), and
    broadcast up to MOST_IDS, some tens of MB, which spares the shuffle of the texts; beyond
    that the join shuffles."""
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


SALTS = 32


def keyed(rows: DataFrame, side: DataFrame, keys: list[str], spread) -> DataFrame:
    """rows left joined with side, a written table with one row for each key, where one key may
    have a third of all rows.  side is counted and broadcast up to half of ``MOST_IDS``; beyond that
    every key is dealt to ``SALTS`` parts by the column spread."""
    if side.count() <= MOST_IDS // 2:
        return rows.join(F.broadcast(side), keys, "left")
    salted = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], "left").drop("salt")


SIEVE = 27


def sieve(keys: DataFrame, col: str) -> np.ndarray:
    """A bitmap of the first ``SIEVE`` bits of the keys, 16 MB however many there are."""
    place = F.shiftrightunsigned(col, 64 - SIEVE)
    rows = keys.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({col}, {64 - SIEVE}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (SIEVE - 6), np.int64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(64 - SIEVE)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


BATCH_BYTES = 4 << 20


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, most: int = BATCH_BYTES):
    """Arrow batches that go to Python end at ``most`` bytes while plans run in here, unless the session
    names a size.  By rows alone a batch of blobs takes all of a partition, outside of the JVM's heap
    and, with what its growing buffers leave behind, for as long as the executor lives."""
    conf, key = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    ours = conf.get(key, None) is None
    if ours:
        conf.set(key, str(most))
    try:
        yield
    finally:
        if ours:
            conf.unset(key)


def mapped(fn, schema: str):
    """``DataFrame.transform`` by ``fn`` over Arrow batches.  Batches have 1000 rows where the
    session names no other number, since texts make them large, and a worker that has done its
    partition gives memory back before it waits for the next one."""

    def run(batches):
        yield from fn(batches)
        _release()

    def apply(df: DataFrame) -> DataFrame:
        conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        if conf.get(key, None) is None:  # read when the plan runs, so it stays set for the session
            conf.set(key, str(ROWS_A_BATCH))
        return df.mapInArrow(run, schema)

    return apply


def _release() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a glibc
        pass
