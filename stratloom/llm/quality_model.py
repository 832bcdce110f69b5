"""Quality classifier: histogram gradient-boosted trees over document statistics.

One pass over the texts makes the statistics of every document, which are a few hundred
bytes however long it is.  The trees are fitted on the driver from labelled rows, at most
``max_rows`` of them (those with the smallest hash of their id; a bound on the hash, from the
count of labelled ids, leaves each task to send its own few), and scored as flat arrays over
whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._boost import Trees
from ._store import Workspace, mapped
from .quality_rules import rule_counts

_GROUPS = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".",
    "comma": b",;:",
    "bang": b"!?",
    "quote": b"'\"`",
    "bracket": b"()[]{}",
    "bar": b"|",
    "hash": b"#",
    "star": b"*",
    "money": b"$%",
    "amp": b"&",
    "angle": b"<>",
    "slash": b"/\\",
    "other": b"-_=+~^@",
    "high": bytes(range(128, 256)),
}
_GROUP = np.full(256, len(_GROUPS), np.int64)
for _i, _b in enumerate(_GROUPS.values()):
    _GROUP[list(_b)] = _i
STATS = (*_GROUPS, "log_words", "word_chars", "symbols", "dup_lines", "repeated", "distinct", "long_words", "short_words", "words_a_line", "words_a_stop", "entropy", "max_share", "top_word")


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents by STATS, as float64."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    groups = len(_GROUPS) + 1
    share = np.bincount(doc * groups + _GROUP[raw], minlength=n * groups).reshape(n, groups) / np.maximum(size, 1)[:, None]
    hist = np.bincount(doc * 256 + X.LOWER[raw], minlength=n * 256).reshape(n, 256) / np.maximum(size, 1)[:, None]
    entropy = -(hist * np.log(np.maximum(hist, 1e-12))).sum(1)
    c = rule_counts(raw, offsets)
    starts, ends, h = X.words(raw, offsets)
    bounds = X.word_bounds(starts, offsets)
    words = np.maximum(c["n_words"], 1)
    long = ends - starts
    wdoc = np.repeat(np.arange(n), c["n_words"])
    order = np.lexsort((h, wdoc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (wdoc[order][1:] != wdoc[order][:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(h)))
    distinct = np.bincount(wdoc[order][first], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, wdoc[order][first], runs)
    lines = np.bincount(doc, raw == 10, n) + 1
    stops = np.bincount(doc, raw == 46, n) + 1
    cols = [
        np.log1p(c["n_words"]),
        c["word_chars"] / words,
        c["n_symbols"] / words,
        c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words,
        distinct / words,
        X.per_doc((long > 12).astype(np.int64), bounds) / words,
        X.per_doc((long < 3).astype(np.int64), bounds) / words,
        np.log1p(c["n_words"] / lines),
        np.log1p(c["n_words"] / stops),
        entropy,
        hist.max(1) if n else np.zeros(0),
        top / words,
    ]
    return np.column_stack([share[:, : groups - 1], *cols])


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, raw = X.buffers(batch.column(1))
        for i, j in X.slices(offsets):
            x = statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["id", "x"])


def _predict(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, len(STATS))
            p = trees.predict(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def held_out(col, folds: int = 4, fold: int = 2):
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees on four fifths of the rows, calibrated on the rest."""
    part = np.arange(len(y)) % 5 == 4
    return Trees().fit(x[~part], y[~part]).calibrate(x[part], y[part])


_PARTS = 1 << 40


def bound(n: int, most: int) -> int:
    """A bound on the hash below which about ``most`` of n ids are, six deviations more to be sure."""
    return _PARTS if n <= most else min(_PARTS, int(_PARTS * (most + 6 * most**0.5) / n))


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 40_000, threshold: float = 0.7) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Labels are learnt only from rows whose crc32(doc_id as text) mod 4 is not 2, at most
    ``max_rows`` of them; inputs of a score are the statistics of the text alone.  With no
    label, or labels of one class, every score is their (smoothed) mean, 0.5 for none.

    A null text counts as empty and is scored; null labels are left out; a null id has a
    score and is not held out; of several labels for an id the largest counts; ids with
    equal hashes are taken by id; repeated rows get equal results; other columns aren't read; no rows give none.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "quality")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    stats = ws.save(rows.transform(mapped(_stats, "id long, x array<double>")), "stats").withColumn("held_out", held_out(F.col("id")))
    marks = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = ws.save(stats.filter("not held_out").select("id").join(marks, "id").distinct(), "known")
    drawn = known.filter(F.pmod(F.xxhash64("id"), F.lit(_PARTS)) < bound(known.count(), max_rows))
    found = stats.join(F.broadcast(drawn), "id").select("id", F.xxhash64("id").alias("h"), "x", "y").toArrow()
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(STATS)) if len(found) else np.zeros((0, len(STATS)))
    order = np.lexsort((*x.T[::-1], found["id"].to_numpy(), found["h"].to_numpy() % _PARTS))[:max_rows]
    x, y = x[order], found["y"].to_numpy()[order].astype(float)
    model = spark.sparkContext.broadcast(fit(x, y))
    return stats.select("id", "held_out", "x").transform(mapped(_predict(model, threshold), "doc_id long, held_out boolean, score double, predicted int"))
