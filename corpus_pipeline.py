"""A corpus in five stages: quality rules, near-duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratloom.llm._store import MOST_IDS, Workspace, ids_side, settle
from stratloom.llm.decontaminate import leaks
from stratloom.llm.minhash import near_duplicates
from stratloom.llm.packing import pack
from stratloom.llm.quality_rules import quality_rules
from stratloom.llm.queries import tokenizer_path
from stratloom.llm.secrets import redact

#: The model stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of its rows, and the name of that column: the doc_id where it names one row,
    else (null and repeated ids) a hash of the row's id and text, so that equal rows have one key."""
    name = "key"
    while name in docs.columns:
        name = f"_{name}"
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select("doc_id", F.lit(True).alias(f"{name}_again"))
    again = Workspace(docs.sparkSession, "keys").save(again, "ids")
    if again.isEmpty():
        return docs.withColumns({name: F.col("doc_id").cast("long"), f"{name}_again": F.lit(False)}), name
    side = again.withColumnRenamed("doc_id", f"{name}_id")
    side = F.broadcast(side) if side.count() <= MOST_IDS else side
    out = docs.join(side, F.col("doc_id").eqNullSafe(F.col(f"{name}_id")), "left").drop(f"{name}_id")
    low = F.lit((1 << 62) - 1)
    hashed = F.xxhash64(F.col("doc_id"), F.col("text")).bitwiseAND(low) + low  # above other ids, which name their group first
    return out.withColumns({name: F.when(F.col(f"{name}_again"), hashed).otherwise(F.col("doc_id").cast("long")), f"{name}_again": F.coalesce(f"{name}_again", F.lit(False))}), name


def _without(docs: DataFrame, keyed: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of keyed whose key isn't among gone, with the columns of docs."""
    gone = Workspace(docs.sparkSession, "dropped").save(gone.select(F.col("doc_id").alias(key)).distinct(), "ids")
    return keyed.join(ids_side(gone), key, "left_anti")


def _settled(stage):
    """stage, before which the executors let go of the memory of what ran before."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        settle(spark)
        return stage(spark, docs, sf_dir)

    return run


@_settled
def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules or their language's perplexity band reject.

    A null, empty or blank text is rejected; rows with null or repeated ids are judged by their own
    text; equal rows stay or go together; other columns pass through; no rows give none."""
    keyed, key = _keyed(docs)
    return _without(docs, keyed, key, quality_rules(keyed, id_col=key, order=6).filter("not kept")).select(*docs.columns)


@_settled
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate component (five words, 0.8).

    One row of equal ones stays; rows with null or repeated ids are compared by their own text;
    texts without words are nobody's copy and stay; other columns pass through; no rows give none."""
    keyed, key = _keyed(docs)
    kept = _without(docs, keyed, key, near_duplicates(keyed, id_col=key, shingle=5, percent=80).filter("not kept"))
    once = kept.filter(f"not {key}_again").select(*docs.columns)
    return once.unionByName(kept.filter(f"{key}_again").dropDuplicates([key]).select(*docs.columns))


@_settled
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that repeat a passage of the benchmark.

    Null and empty texts stay; rows with null or repeated ids are judged by their own text; other
    columns pass through; without documents or items nothing is dropped."""
    keyed, key = _keyed(docs)
    return _without(docs, keyed, key, leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)).select(*docs.columns)


@_settled
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark; n_chars, where there is one, follows the new text.

    Null and empty texts stay as they are, every row stays, whatever its id; no rows give none."""
    out = redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@_settled
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of 2048 tokens; one row per piece.

    A null or empty text is its end token alone; null ids stay null and repeated rows are packed
    each; other columns aren't read; no rows give none."""
    return pack(docs, tokenizer=tokenizer_path("word_bpe_49k.json"), capacity=2048, end=0)


STAGES = [
    ("quality rules", rules_stage),
    ("near-duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret scan", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        then, docs = docs, ws.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        ws.drop(then)
    return docs
