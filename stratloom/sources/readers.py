"""Sources and sinks: grid and sample tables, result tables, run registry, provenance."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.grid import missing_to_null
from .sheets import read_sheets

#: Fixed column names of a grid table.
COORDS = ("XC", "YC", "ZC")
COVARIATES = ("Fe", "FeO", "MagSus", "S")
RESPONSES = ("DTR", "Magnetic")
#: Spellings of missing values, fixed.
MISSING = ("", "-", "nan", "na", "n/a", "null", "none", "--")


class SchemaError(ValueError):
    """A table lacks columns."""


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV, xlsx, JSON, ORC or Parquet by suffix (a folder of such files too); CSV and sheet columns stay
    text, so nothing is read twice to guess types."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.csv(path, header=True)
    if kind == "xlsx":
        return read_sheets(spark, path)
    if kind in ("json", "jsonl"):
        return spark.read.json(path)
    if kind == "orc":
        return spark.read.orc(path)
    return spark.read.parquet(path)


def match_columns(df: DataFrame, wanted: Sequence[str], fallbacks: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Columns under the wanted names, whatever their case; then under the fallback names."""
    have = {c.lower(): c for c in df.columns}
    picked, lost = {}, []
    for w in wanted:
        hit = next((have[x.lower()] for x in (w, *(fallbacks or {}).get(w, ())) if x.lower() in have), None)
        (picked.__setitem__(w, hit) if hit else lost.append(w))
    if lost:
        raise SchemaError(f"missing columns: {', '.join(lost)}")
    rest = [c for c in df.columns if c not in picked.values() and c.lower() not in {w.lower() for w in picked}]
    return df.select(*(F.col(f"`{c}`").alias(w) for w, c in picked.items()), *(F.col(f"`{c}`") for c in rest))


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """A grid table: doubles, missing spellings as null, rows without coordinates dropped."""
    df = match_columns(read_table(spark, path), (*COORDS, *COVARIATES, *RESPONSES), {"XC": ("X",), "YC": ("Y",), "ZC": ("Z",)})
    df = missing_to_null(df, (*COORDS, *COVARIATES, *RESPONSES), MISSING)
    return df.filter(F.col("XC").isNotNull() & F.col("YC").isNotNull() & F.col("ZC").isNotNull())


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A point-support table; its spellings become those of the grid."""
    df = match_columns(read_table(spark, path), (*COORDS, *COVARIATES, *RESPONSES), {"XC": ("X",), "YC": ("Y",), "ZC": ("Z",), "Fe": ("FE",), "FeO": ("FEO",), "MagSus": ("Magsus",)})
    return missing_to_null(df, (*COORDS, *COVARIATES, *RESPONSES), MISSING)


def write_csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """A result table as CSV, doubles rounded where digits are given."""
    if digits is not None:
        df = df.withColumns({f.name: F.round(f.name, digits) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})
    df.write.mode("overwrite").csv(path, header=True)


def write_matrix(df: DataFrame, path: str, by: str | None = None) -> None:
    """Patterns, roles or models: Parquet with array columns, partitioned where asked."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def write_json(spark: SparkSession, record: dict, path: str) -> None:
    """A one-row JSON record, keys sorted."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def contract_hash(record: dict) -> str:
    """SHA-256 of the record as compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def newest_run(registry: DataFrame, marker: str = "complete", by: str = "modified") -> DataFrame:
    """The newest run of each kind that carries the marker: by time, or by name."""
    order = F.struct(by, "run") if by != "run" else F.struct("run")
    return registry.filter(F.col(marker)).groupBy("kind").agg(F.max_by("run", order).alias("run"))


@dataclass(frozen=True)
class Settings:
    """What a run can be told: sizes, seeds, paths.  Nothing is asked for interactively."""

    root: str = "."
    kernel: int = 3
    folds: int = 5
    coverage: float = 0.70
    cell: tuple[float, float, float] = (5.0, 5.0, 2.0)
    quick: bool = False
    seed: int = 42
    extra: dict = field(default_factory=dict)

    @staticmethod
    def of(spark: SparkSession) -> "Settings":
        """From ``spark.stratloom.*`` session settings."""
        get = lambda k, d: spark.conf.get(f"spark.stratloom.{k}", str(d))
        d = Settings()
        return Settings(root=get("root", d.root), kernel=int(get("kernel", d.kernel)), folds=int(get("folds", d.folds)), coverage=float(get("coverage", d.coverage)), quick=get("quick", d.quick).lower() == "true", seed=int(get("seed", d.seed)))

    def record(self) -> dict:
        return asdict(self)


def data_path(fold_config: dict, root: str, name: str) -> str:
    """The path a fold configuration names, else the one under the root."""
    return fold_config.get("data", {}).get(name) or f"{root.rstrip('/')}/{name}"
