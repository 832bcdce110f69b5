"""Sharding along a Hilbert curve, in DataFrame operations alone.

Language, source, size and id are quantised to three bits each, at cuts that share the
rows equally; strings are cut in their order, by the bytes after the prefix that all of a
column have in common.  The 4096 cells are walked in Hilbert order, so a run of rows is compact
in all four dimensions and the minima and maxima that Parquet keeps for a file prune on any of
them.  Rows with equal texts share one cell (that of the group's smallest values) and stand side
by side; where the law of equal row counts asks for it, a shard ends within such a group.

One range exchange over (cell, group, doc_id) orders the rows; doc_id makes its bounds
fine, so neither a full cell nor a large group of copies ends up in one task.  A row's
place is its index in its partition plus the rows of the partitions before, of which
there are as many as shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._store import Workspace, keyed

BITS = 3
DIMS = ("lang", "source", "size", "id")


def hilbert_index(df: DataFrame, dims: list[str], bits: int, out: str) -> DataFrame:
    """Adds the Hilbert index of the cells ``dims`` (integers of ``bits`` bits), after
    Skilling's transposed form; each step is one projection of integer operations."""
    x = [f"_h{i}" for i in range(len(dims))]
    df = df.withColumns({a: F.col(b).cast("int") for a, b in zip(x, dims, strict=True)})

    def bit(c: str, q: int) -> Column:
        return F.col(c).bitwiseAND(F.lit(q)) != 0

    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(len(x)):
            swap = F.col(x[0]).bitwiseXOR(F.col(x[i])).bitwiseAND(F.lit(q - 1))
            new = {x[0]: F.when(bit(x[i], q), F.col(x[0]).bitwiseXOR(F.lit(q - 1))).otherwise(F.col(x[0]).bitwiseXOR(swap))}
            if i:
                new[x[i]] = F.when(bit(x[i], q), F.col(x[i])).otherwise(F.col(x[i]).bitwiseXOR(swap))
            df = df.withColumns(new)
    for i in range(1, len(x)):
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    turn = F.lit(0)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = turn.bitwiseXOR(F.when(bit(x[-1], q), F.lit(q - 1)).otherwise(F.lit(0)))
    df = df.withColumn("_t", turn)
    df = df.withColumns({c: F.col(c).bitwiseXOR(F.col("_t")) for c in x})
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for c in x:
            index = index * 2 + F.shiftright(c, b).bitwiseAND(F.lit(1))
    return df.withColumn(out, index).drop(*x, "_t")


def _ordered(col: str, skip: int) -> Column:
    """The six bytes of a string after the first ``skip`` as a number, in the strings' order."""
    tail = F.substring(F.col(col).cast("binary"), skip + 1, 6)
    return F.conv(F.rpad(F.hex(tail), 12, "0"), 16, 10).cast("long")


def _shared(lo: str | None, hi: str | None) -> int:
    """Bytes that all strings from lo to hi begin with."""
    a, b = (lo or "").encode(), (hi or "").encode()
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def hilbert_shards(docs: DataFrame, *, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``
    and the curve index ``cell``.

    ``size``: UTF-8 bytes plus 1; ``slot``: place in the shard, without gaps.  The law is
    ``rows``: the numbers of rows of any two shards differ by one at most.

    A null text is empty; null languages, sources and ids come first in their dimension; rows that
    tie in all that orders them take their slots in any order; repeated rows take a slot
    each; other columns aren't read; no rows give none.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "shards")
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("group"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
    )
    rows = ws.save(rows, "rows")
    same = ["group", "size", "text_crc32"]
    groups = rows.groupBy(*same).agg(F.min("lang").alias("g_lang"), F.min("source").alias("g_source"), F.min("doc_id").alias("g_id"), F.count("*").alias("copies"))
    groups = ws.save(groups.filter("copies > 1").withColumn("grouped", F.lit(True)).drop("copies"), "groups")
    span = rows.agg(F.count("*").alias("n"), *(f(c).alias(f"{a}_{c}") for c in ("lang", "source") for a, f in (("lo", F.min), ("hi", F.max)))).first()
    total, most = span["n"], (1 << BITS) - 1
    number = {c: _ordered(c, _shared(span[f"lo_{c}"], span[f"hi_{c}"])) for c in ("lang", "source")} | {"size": F.col("size"), "id": F.col("doc_id")}
    cuts = rows.agg(*(F.percentile_approx(number[d], [(i + 1) / (most + 1) for i in range(most)], 10000).alias(d) for d in DIMS)).first()
    keyed_rows = keyed(rows, groups, same, "doc_id")
    for own, of_group in (("lang", "g_lang"), ("source", "g_source"), ("doc_id", "g_id")):
        keyed_rows = keyed_rows.withColumn(of_group, F.when(F.col("grouped"), F.col(of_group)).otherwise(F.col(own)))
    place = keyed_rows.select("doc_id", *same, "g_id", F.col("g_lang").alias("lang"), F.col("g_source").alias("source"))
    value = number | {"id": F.col("g_id")}
    place = place.withColumns({f"q_{d}": sum((F.coalesce(value[d] > cut, F.lit(False)).cast("int") for cut in cuts[d] or []), F.lit(0)) for d in DIMS})
    place = hilbert_index(place, [f"q_{d}" for d in DIMS], BITS, "cell").select("doc_id", "size", "text_crc32", "cell", "g_id", "group")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["cell", "g_id", "group", "doc_id"]
    at = F.monotonically_increasing_id()
    dealt = place.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"part": F.shiftright(at, 33), "row": at.bitwiseAND(F.lit((1 << 33) - 1))})
    dealt = ws.save(dealt.drop("g_id", "group"), "dealt")
    counts = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a partition
    before, starts = 0, [F.lit(-1), F.lit(0)]
    for part, n in counts:
        starts += [F.lit(part).cast("long"), F.lit(before).cast("long")]
        before += n
    ws.drop(rows, groups)
    rank = F.create_map(*starts)[F.col("part")] + F.col("row") if counts else F.col("row")
    shard = F.expr(f"(rank * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        dealt.withColumn("rank", rank.cast("long"))
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("rank") - first).cast("long"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Parquet files by shard, in curve order within each file.

    Rows meet their places by id and text, null ids and texts included, and the k-th of several equal
    ones takes the k-th place, so every row is written once.  No rows write no file."""
    keys = ["_id", "_size", "_crc", "_nth"]
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")

    def numbered(df: DataFrame, order) -> DataFrame:
        return df.withColumn("_nth", F.row_number().over(W.partitionBy(*keys[:3]).orderBy(order)))

    own = numbered(docs.withColumns({"_id": F.col(id_col).cast("long"), "_size": (F.octet_length(raw) + 1).cast("long"), "_crc": F.crc32(raw)}), F.lit(0))
    at = placed.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    at = numbered(at, F.struct("_shard", "_slot"))
    same = [own[k].eqNullSafe(at[k]) for k in keys]
    out = own.join(at, same).select(*(own[c] for c in docs.columns), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))
    out.repartition("shard", F.expr("slot div 1000000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
