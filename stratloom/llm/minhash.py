"""Near-duplicate components by bottom-k sketches.

One hash function gives each document the sorted set of its shingle hashes; the k
smallest are its sketch.  Inverted lists of the sketch values propose pairs, the k
smallest values of the union of two sketches estimate their similarity, and the full
sets decide.

Which pairs are proposed.  Documents with equal sets form one class at once, which
keeps copies out of all later joins.  Two sketches of k values with a similarity of 0.8
share 51 of 64 values on average, with a deviation of 3.2; fewer than half, six deviations
below, has a probability near 1e-9.  So with the values of a sketch ordered from the
rarest to the commonest, two similar documents share one among all but the last half
(sets not larger than 0.8 k are compared in full and the bound is exact).  Common
passages stand at the end of that order and don't put their documents together.

How long lists are handled.  Each list links its members with its hub, the member with
the commonest sketch.  These links make components; members of one are not compared with
each other any more.  What is left are pairs of one list in different components, of which
one, C, stands outside of the component that most of the list is in.  C has a hub P that it
was compared with and isn't linked to.  A document A that is linked to C has
|A & C| >= t * (|A| + |C|) for t = s / (1 + s); so if |A| > |C & P| / t - |C|, then A and C
share more than C & P and A contains a value of C - P.  The lists of those values, which are
what sets C apart, propose A; only documents not larger than that bound, or a C without
such a P, go over the first lists again.  A pair is proposed only if 512 parity bits of
each set allow it: every value flips one bit, so two sets differ in as many values as in
bits at least, and linked sets differ in (1 - s) / (1 + s) of their values at most.  So a
large group of near copies doesn't make the pairs of its square, no list is cut, and no link
between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import _text as X
from ._store import Workspace, ids_side, keyed, mapped, passes, sieve

_FACTORS = np.random.default_rng(77).integers(1 << 62, 1 << 63, 64, dtype=X.U) | X.U(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document, as int64."""
    starts, _, h = X.words(raw, offsets)
    bounds = X.word_bounds(starts, offsets)
    grams = np.zeros(max(0, len(h) - size + 1), X.U)
    for i in range(size if len(grams) else 0):
        grams += h[i : i + len(grams)] * _FACTORS[i]
    grams = X.mix(grams).view(np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:  # the whole sequence is the one shingle
            yield X.mix(np.array([(h[a:b] * _FACTORS[: b - a]).sum() + X.U(b - a)], X.U)).view(np.int64)
        else:
            yield grams[:0]


SIGNS = 8  # 64 parity bits each


def parity(values: np.ndarray) -> np.ndarray:
    """512 bits, each the parity of the number of values that it stands for."""
    at = (values.view(X.U) >> X.U(20)) % X.U(64 * SIGNS)
    bits = np.bincount(at.astype(np.int64), minlength=64 * SIGNS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sketches(size: int, k: int, whole: bool = False):
    """Rows of a text's set: its size, marks, sketch and parities; with ``whole`` all of it too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = X.buffers(batch.column(1))
            for i, j in X.slices(offsets):
                part = raw[offsets[i] : offsets[j]]
                n, marks, sketches, signs, sets = [], [], [], [], []
                for s in shingle_sets(part, offsets[i : j + 1] - offsets[i], size):
                    n.append(len(s))
                    marks.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64))
                    sketches.append(s[:k])
                    signs.append(parity(s))
                    if whole:
                        sets.append(s)
                marks = np.array(marks).reshape(-1, 2)
                cols = [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy()), _lists(sketches), _lists(signs)]
                yield pa.RecordBatch.from_arrays(cols + ([_lists(sets)] if whole else []), ["id", "n", "m1", "m2", "sketch", "sign"] + ["grams"] * whole)

    return run


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))


def _sieved(bits):
    """(id, v) of the values of each set that pass the sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy()
            v = batch.column(1).values.to_numpy()[offsets[0] : offsets[-1]]
            hit = np.flatnonzero(passes(bits.value, v.view(X.U)))
            row = np.searchsorted(offsets - offsets[0], hit, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(v[hit])], ["id", "v"])

    return run


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, component) for every node of edges (a, b), by alternating large and small
    stars; each round is a written table."""

    def stars(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        return small.select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()

    now = ws.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        then, now = now, ws.save(stars(now), "stars")
        ws.drop(then)
        was, seen = seen, mark(now)
        if seen == was:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, k: int = 64) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of
    distinct ``shingle``-word shingles; ``component_id`` is the smallest id reachable over
    links and ``kept`` marks the documents with the smallest id of their component.

    A null, empty or blank text has an empty set, is linked with nothing and is kept.
    A row without an id is linked with nothing: its component is null and it is kept.
    Rows that repeat an id and its text count as one document and get equal results (so all
    of them are kept or none).  Rows of one id with different texts are versions of one
    document: what one version is linked to, the others are in the component of too.
    Other columns of the input are not read, whatever their names.  No rows give no rows.

    ``percent`` must be 80 or more: the bound on shared sketch values stands for that.
    """
    if percent < 80:
        raise ValueError("the sketch bound holds for a similarity of 0.8 or more")
    spark = docs.sparkSession
    ws = Workspace(spark, "minhash")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n long, m1 long, m2 long, sketch array<long>, sign array<long>"
    base = ws.save(rows.transform(mapped(_sketches(shingle, k), schema)).withColumn("row", F.monotonically_increasing_id()), "sketches")
    whole = base.filter("n > 0 and id is not null")
    classes = whole.groupBy("m1", "m2", "n").agg(F.min("id").alias("rep"), F.min_by("row", "id").alias("first"), F.count("*").alias("copies"))
    classes = ws.save(classes, "classes")
    copied = ws.save(classes.filter("copies > 1").select("m1", "m2", "n", "first"), "copied")
    reps = keyed(whole.select("id", "row", "n", "m1", "m2", "sketch"), copied, ["m1", "m2", "n"], "row").filter("first is null or first = row")

    # inverted lists: the values that two classes or more have retained, for each class the rarest first
    postings = reps.select("id", "n", F.explode("sketch").alias("h"))
    shared = postings.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    c = F.when(F.col("n") <= k * 8 // 10, F.expr("(n * 4 + 4) div 5")).otherwise(F.expr(f"(least(n, {k}) + 1) div 2"))
    own = W.partitionBy("id", "n")
    lists = (
        postings.join(shared, "h")
        .withColumns({"held": F.count("*").over(own), "common": F.sum(F.log2("df")).over(own)})
        .filter(F.col("held") >= c)
        .withColumn("at", F.row_number().over(own.orderBy("df", "h")))
        .filter(F.col("at") <= F.col("held") - c + 1)
        .select("id", "n", "h", F.round("common", 6).alias("common"))
    )
    retained = ws.save(lists, "lists")
    hubs = retained.groupBy("h").agg(F.max(F.struct("common", F.negative("id").alias("id"))).alias("x"), F.count("*").alias("len")).filter("len > 1").select("h", F.negative("x.id").alias("hub"))
    lists = ws.save(retained.join(hubs, "h").select("h", "id", "n", "hub"), "hubs")
    ws.drop(retained)
    members = ws.save(lists.select("id").distinct(), "ids")
    # all that is known of the members, so that nothing below reads the other documents again
    sets = ws.save(rows.join(ids_side(members), "id", "left_semi").transform(mapped(_sketches(shingle, k, whole=True), f"{schema}, grams array<long>")).filter("n > 0"), "sets")
    near = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))

    def of(ids: DataFrame, *columns: str) -> DataFrame:
        """Columns of the members among ids, a written table."""
        return sets.join(ids_side(ids), "id", "left_semi").select("id", *columns)

    def paired(pairs: DataFrame, *columns: str) -> DataFrame:
        """pairs, a written table, with columns of both ends, as a_ and b_; what moves are the
        columns of b, to a, and those of the distinct a."""
        ends = ws.save(pairs.select(F.col("a").alias("id")).distinct(), "ends")
        left = of(ends, *columns).select(F.col("id").alias("a"), *(F.col(x).alias(f"a_{x}") for x in columns))
        right = sets.select(F.col("id").alias("b"), *(F.col(x).alias(f"b_{x}") for x in columns)).join(ids_side(pairs), "b")
        return right.join(left, "a")

    def checked(pairs: DataFrame) -> DataFrame:
        """(a, b, both, na, nb, linked) of the pairs that the sketch of the union leaves, by the full sets."""
        pairs = ws.save(pairs, "proposed")
        union = F.slice(F.array_sort(F.array_union("a_sketch", "b_sketch")), 1, k)
        both = F.size(F.array_intersect(F.array_intersect(union, F.col("a_sketch")), F.col("b_sketch")))
        left = ws.save(paired(pairs, "n", "sketch").filter((2 * both >= F.size(union)) & near(F.col("a_n"), F.col("b_n"))).select("a", "b"), "pairs")
        out = paired(left, "n", "grams").select("a", "b", F.col("a_n").alias("na"), F.col("b_n").alias("nb"), F.size(F.array_intersect("a_grams", "b_grams")).cast("long").alias("both"))
        out = ws.save(out.withColumn("linked", 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))), "checked")
        ws.drop(pairs, left)
        return out

    star = checked(lists.filter("hub <> id").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    # the versions of one id
    many = ws.save(whole.groupBy("id").agg(F.min("m1").alias("x"), F.max("m1").alias("y")).filter("x < y").select("id"), "many")
    of_many = whole.join(ids_side(many), "id", "left_semi").join(classes, ["m1", "m2", "n"]).select("id", "rep")
    versions = of_many.join(of_many.groupBy("id").agg(F.min("rep").alias("least")), "id").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    first = connected_components(star.filter("linked").select("a", "b").union(versions), ws)

    # pairs of one list in different components
    member = lists.join(first.withColumnRenamed("node", "id"), "id", "left").select("h", "id", "n", F.coalesce("component", "id").alias("c"))
    part = member.groupBy("h", "c").agg(F.count("*").alias("m"))
    main = part.groupBy("h").agg(F.max(F.struct("m", "c")).alias("x"), F.count("*").alias("parts")).filter("parts > 1").select("h", F.col("x.c").alias("main"))
    live = ws.save(member.join(main, "h"), "live")
    ws.drop(lists)
    apart = star.filter("not linked")
    hub_of = (
        apart.select(F.col("b").alias("id"), F.col("a").alias("p"), "both", F.col("nb").alias("n"))
        .union(apart.select("a", "b", "both", "na"))
        .groupBy("id")
        .agg(F.max(F.struct("both", "p", "n")).alias("x"))
        .select("id", F.col("x.p").alias("p"), F.floor(F.col("x.both") * (100 + percent) / percent - F.col("x.n")).cast("long").alias("bound"))
    )
    known = ws.save(live.select("id", "c", "n").distinct(), "known")
    whom = known.join(of(ws.save(known.select("id").distinct(), "ids"), "n", "sign"), ["id", "n"])
    whom = ws.save(whom.join(hub_of, "id", "left"), "whom")
    outside = live.filter("c <> main").select("id").distinct().join(whom, "id")
    outside = ws.save(outside, "outside")

    def may(one: str, other: str):
        """Whether sets of these rows can be linked, in different components."""
        apart = sum((F.bit_count(F.col(f"{one}.sign")[i].bitwiseXOR(F.col(f"{other}.sign")[i])) for i in range(SIGNS)), F.lit(0))
        n1, n2 = F.col(f"{one}.n"), F.col(f"{other}.n")
        return (F.col(f"{one}.c") != F.col(f"{other}.c")) & near(n1, n2) & ((100 + percent) * apart <= (100 - percent) * (n1 + n2))

    # what sets those outside apart from their hubs, and who else has it
    to_hub = ws.save(outside.filter("p is not null").select(F.col("p").alias("a"), F.col("id").alias("b")).distinct(), "to_hub")
    differ = ws.save(paired(to_hub, "grams").select(F.col("b").alias("id"), F.explode(F.array_except("b_grams", "a_grams")).alias("v")), "differ")
    bits = spark.sparkContext.broadcast(sieve(differ, "v"))
    around = of(ws.save(whom.select("id").distinct(), "ids"), "grams").transform(mapped(_sieved(bits), "id long, v long"))
    apart_pairs = differ.join(outside, "id").alias("x").join(around.join(whom, "id").alias("y"), F.col("x.v") == F.col("y.v")).filter(may("x", "y"))
    held = live.select("h", "id", "main")
    again = held.join(outside, "id").filter("c <> main").alias("x").join(held.join(whom, "id").alias("y"), F.col("x.h") == F.col("y.h")).filter((F.col("y.n") <= F.coalesce("x.bound", "y.n")) & may("x", "y"))
    apart_pairs, again = (t.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")) for t in (apart_pairs, again))
    rest = apart_pairs.union(again).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = checked(rest).filter("linked").select("a", "b")
    final = connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), ws)
    ws.drop(sets, live, known, outside, whom, differ, members, to_hub, star)

    # only classes of several rows or in a component of several have another name than their id
    names = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    names = ws.save(names.filter("copies > 1 or component <> rep").select("m1", "m2", "n", "component"), "names")
    ws.drop(classes, copied)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return keyed(base.select("id", "row", "n", "m1", "m2"), names, ["m1", "m2", "n"], "row").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
