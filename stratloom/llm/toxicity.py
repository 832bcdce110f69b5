"""Toxicity by multiple-instance learning: a document is a bag of sentences, only it has a label.

A sentence's score is a logistic function of the counts of its features; a document's is the noisy-or
of its sentences, with a leak that stands for labels no sentence explains.  Training follows
the likelihood of the document labels through the noisy-or down to the sentences, with an L1
penalty that leaves few features.  The sentences that explain a label are then read off their own scores.

Features of a word are the word, its beginnings and its ends, each as a 64-bit hash, so a
model is two sorted arrays and a word's weight the sum over its features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import Workspace, batch_bytes, mapped
from .lexical import TERM

HEADS = (3, 4, 5, 6, 7, 8)
TAILS = (3, 4, 5)
FEATURES = 4096
U = np.uint64

_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
#: The full stop, exclamation and question mark of full width, as the last bytes of three.
_WIDE = ((0xE3, 0x80, 0x82), (0xEF, 0xBC, 0x81), (0xEF, 0xBC, 0x9F))


def sentence_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where sentences begin: at the start of a text, behind a line feed, behind a stop that
    white space follows and behind a stop of full width."""
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets[:-1]] = True
    edge[1:] |= raw == 10
    if len(raw) > 1:
        edge[1:-1] |= _STOP[raw[:-1]] & X.IS_SPACE[raw[1:]]
    for a, b, c in _WIDE:
        if len(raw) > 2:
            edge[3:] |= (raw[:-2] == a) & (raw[1:-1] == b) & (raw[2:] == c)
    return np.flatnonzero(edge[: len(raw)])


def word_features(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, hashes) of each kind of feature of the words; one kind's hashes never equal another's
    but by chance."""
    table, _, _ = X._tables()
    yield np.arange(len(starts)), whole
    for kinds, tail in ((HEADS, False), (TAILS, True)):
        for n in kinds:
            rows = np.flatnonzero(ends - starts > n)
            at = (ends[rows] - n if tail else starts[rows])[:, None] + np.arange(n)
            h = np.full(len(rows), n + 100 * tail + 1, U)
            for c in range(n):
                h = X.mix(h ^ table[text[at[:, c]]])
            yield rows, h


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    text = TERM[raw]
    starts, ends, h = X.words(text, offsets, lower=False)
    return text, starts, ends, h


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    return first, of


class Model:
    """``bias`` of a sentence, ``leak`` of a document, and the weights of some features."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float, leak: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias, self.leak = hashes[order], weights[order], bias, leak

    def words(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """The weight of each word."""
        out = np.zeros(len(starts))
        if len(self.hashes):
            for rows, h in word_features(text, starts, ends, whole):
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = self.hashes[at] == h
                out[rows[hit]] += self.weights[at[hit]]  # a row once in each kind
        return out

    def sentences(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the sentences and their margins."""
        begin = sentence_starts(raw, offsets)
        text, starts, ends, h = _words(raw, offsets)
        first, of = _distinct(h)
        weight = self.words(text, starts[first], ends[first], h[first])[of]
        of_word = np.searchsorted(begin, starts, "right") - 1
        return begin, self.bias + np.bincount(of_word, weight, len(begin))

    def documents(self, margins: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Noisy-or over the sentences [bounds[i], bounds[i + 1]) of each document, and the leak."""
        return -np.expm1(-(X.per_doc(softplus(margins), bounds) + self.leak))


def softplus(z: np.ndarray) -> np.ndarray:
    """-log(1 - p) of the logistic p."""
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def fit(doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, times: np.ndarray, n_sentences: np.ndarray, y: np.ndarray, weight: np.ndarray, features: int, *, l1: float = 2e-4, steps: int = 400, rate: float = 0.15) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak that maximise the penalised likelihood of the labels y.

    Entries (doc, sentence, feature, times) are the counts of the features; sentences of a document
    without any feature are only counted (``n_sentences`` are all of them).  Proximal steps
    with scaled gradients; the penalty spares bias and leak."""
    n = len(y)
    key = doc * (int(sentence.max(initial=0)) + 1) + sentence
    _, first, row = np.unique(key, return_index=True, return_inverse=True)
    of, rows = doc[first], len(first)
    plain = n_sentences - np.bincount(of, minlength=n)
    value = np.log1p(times) / np.log(2)
    w, bias, leak = np.zeros(features), -5.0, -3.0
    rho = weight / weight.sum()
    m, v = np.zeros(features + 2), np.zeros(features + 2)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, value * w[feature], rows)
        s = np.bincount(of, softplus(z), n) + plain * softplus(np.array([bias]))[0] + softplus(np.array([leak]))[0]
        none = np.exp(-s)
        d = rho * np.where(y == 1, -none / np.maximum(1 - none, 1e-12), 1.0)  # loss by s
        dz = d[of] * sigmoid(z)
        g = np.concatenate([np.bincount(feature, value * dz[row], features), [dz.sum() + (d * plain).sum() * sigmoid(np.array([bias]))[0], d.sum() * sigmoid(np.array([leak]))[0]]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        scale = rate * min(1.0, 4 * (1 - step / (steps + 1))) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        move = scale * m / (1 - 0.9**step)
        w = w - move[:features]
        w = np.sign(w) * np.maximum(np.abs(w) - scale[:features] * l1, 0)
        bias, leak = min(bias - move[-2], -1.0), min(leak - move[-1], -0.5)
    return w, float(bias), float(leak)


def _screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents with it of either label) of blocks of labelled texts."""
    for batch in batches:
        offsets, raw = X.buffers(batch.column(1))
        label = batch.column(2).to_numpy()
        for i, j in X.slices(offsets):
            off = offsets[i : j + 1] - offsets[i]
            text, starts, ends, h = _words(raw[offsets[i] : offsets[j]], off)
            doc = np.searchsorted(off, starts, "right") - 1
            order = np.lexsort((h, doc))
            first = order[np.append(True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1]))] if len(h) else order
            keys, docs = [], []
            for rows, f in word_features(text, starts[first], ends[first], h[first]):
                keys.append(f)
                docs.append(doc[first][rows])
            k, d = np.concatenate(keys), np.concatenate(docs)
            order = np.lexsort((d, k))
            k, d = k[order], d[order]
            once = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])) if len(k) else np.zeros(0, bool)
            k, bad = k[once], label[i:j][d[once]]
            head = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
            total = np.diff(np.append(head, len(k)))
            pos = np.add.reduceat(bad, head) if len(head) else total
            yield pa.RecordBatch.from_arrays([pa.array(k[head].view(np.int64)), pa.array(pos.astype(np.int64)), pa.array((total - pos).astype(np.int64))], ["feature", "bad", "good"])


def _entries(known):
    """Per labelled text: its number of sentences and (sentence, feature number, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = known.value
        for batch in batches:
            offsets, raw = X.buffers(batch.column(1))
            for i, j in X.slices(offsets):
                off = offsets[i : j + 1] - offsets[i]
                part = raw[offsets[i] : offsets[j]]
                begin = sentence_starts(part, off)
                text, starts, ends, h = _words(part, off)
                first, of = _distinct(h)
                sent = np.searchsorted(begin, starts, "right") - 1
                order = np.argsort(of, kind="stable")  # the words of each distinct word
                ptr = np.searchsorted(of[order], np.arange(len(first) + 1))
                s, f = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for rows, x in word_features(text, starts[first], ends[first], h[first]):
                    at = np.minimum(np.searchsorted(hashes, x), len(hashes) - 1)
                    hit = hashes[at] == x
                    rows, at = rows[hit], at[hit]
                    n = ptr[rows + 1] - ptr[rows]
                    place = np.arange(int(n.sum())) + np.repeat(ptr[rows] - (np.cumsum(n) - n), n)
                    s.append(sent[order[place]])
                    f.append(np.repeat(at, n))
                key, times = np.unique(np.concatenate(s) * len(hashes) + np.concatenate(f), return_counts=True)
                s, f = key // len(hashes), key % len(hashes)
                bounds = np.searchsorted(begin, off)
                cuts = pa.array(np.searchsorted(s, bounds).astype(np.int32))
                doc = np.searchsorted(bounds, s, "right") - 1
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (s - bounds[doc], f, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.diff(bounds)), *lists], ["id", "y", "n", "sentence", "feature", "times"])

    return run


def _scored(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        cut = np.log(threshold / (1 - threshold))
        for batch in batches:
            offsets, raw = X.buffers(batch.column(1))
            for i, j in X.slices(offsets):
                part, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                begin, margin = m.sentences(part, off)
                bounds = np.searchsorted(begin, off)
                p = m.documents(margin, bounds)
                bad = np.flatnonzero(margin >= cut)
                points = np.append(0, np.cumsum(X.codepoints(part))) if len(bad) else np.zeros(1, np.int64)
                doc = np.searchsorted(bounds, bad, "right") - 1
                ends = np.append(begin, len(part))
                start, end = points[begin[bad]] - points[off[doc]], points[ends[bad + 1]] - points[off[doc]]
                cuts = pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32))
                spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64)), pa.array(1 / (1 + np.exp(-np.clip(margin[bad], -35, 35))))], ["start", "end", "score"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.clip(p, 0, 1)), pa.array((p >= threshold).astype(np.int32)), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(cuts, spans)], ["doc_id", "score", "predicted", "n_sentences", "toxic"]
                )

    return run


def held_out(col, folds: int = 5, fold: int = 0):
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


_PARTS = 1 << 40


def _drawn(known: DataFrame, y: int, most: int) -> tuple[DataFrame, int]:
    """At most ``most`` ids with label y, those with the smallest hash, and how many there are."""
    mine = known.filter(F.col("y") == y)
    n = mine.count()
    bound = _PARTS if n <= most else min(_PARTS, int(_PARTS * (most + 6 * most**0.5) / n))
    at = F.pmod(F.xxhash64("id"), F.lit(_PARTS))
    return mine.filter(at < bound).orderBy(at, "id").limit(most), n


def train(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, max_rows: int) -> Model:
    """The model from labelled rows of docs that are not held out, at most ``max_rows`` of either label."""
    spark = docs.sparkSession
    ws = Workspace(spark, "toxicity")
    marks = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).filter(~held_out(F.col("id"))).distinct()
    known = ws.save(ids.join(marks, "id"), "known")
    bad, n_bad = _drawn(known, 1, max_rows)
    good, n_good = _drawn(known, 0, max_rows)
    if not n_bad or not n_good:  # labels of one class, or none
        p = 0.5 if not n_bad + n_good else (n_bad + 1) / (n_bad + n_good + 2)
        return Model(np.zeros(0, U), np.zeros(0), -np.inf, float(-np.log1p(-p)))
    drawn = ws.save(bad.unionByName(good), "drawn")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn), "id").select("id", "text", F.col("y").cast("long").alias("y"))
    texts = ws.save(texts, "texts")
    with batch_bytes(spark):
        seen = texts.transform(mapped(_screened, "feature long, bad long, good long")).groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        a, b = F.col("bad") / min(n_bad, max_rows), F.col("good") / min(n_good, max_rows)
        apart = F.abs(a - b) / F.sqrt(F.lit(0.002) + a + b)
        top = seen.filter("bad + good >= 3").select("feature", apart.alias("apart")).orderBy(F.col("apart").desc(), "feature").limit(FEATURES).toArrow()
        hashes = np.sort(top["feature"].to_numpy().view(U))
        if not len(hashes):
            hashes = np.zeros(1, U)
        table = spark.sparkContext.broadcast(hashes)
        rows = texts.transform(mapped(_entries(table), "id long, y long, n long, sentence array<int>, feature array<int>, times array<int>")).toArrow()
    # tasks send rows in any order; a fixed one makes the sums the same in every run
    rows = rows.take(pa.array(np.lexsort((rows["n"].to_numpy(), rows["y"].to_numpy(), rows["id"].to_numpy()))))
    lists = rows["sentence"].combine_chunks()
    doc = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
    flat = lambda c: rows[c].combine_chunks().flatten().to_numpy().astype(np.int64)
    y = rows["y"].to_numpy()
    weight = np.where(y == 1, n_bad / max((y == 1).sum(), 1), n_good / max((y == 0).sum(), 1))
    w, bias, leak = fit(doc, flat("sentence"), flat("feature"), flat("times").astype(float), rows["n"].to_numpy(), y, weight, len(hashes))
    used = np.flatnonzero(w)
    return Model(hashes[used], w[used], bias, float(softplus(np.array([leak]))[0]))


def toxic_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 5_000, threshold: float = 0.5) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted, n_sentences, toxic``; ``toxic`` are
    the sentences with a score of their own of ``threshold`` or more, as (start, end, score) in
    code points.

    Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0, at most ``max_rows`` of
    either label (those with the smallest hash of their id), weighted back to their share.
    Inputs of a score are the words of the text alone.  With labels of one class every score is
    their smoothed mean, 0.5 for none.

    A null or empty text has no sentence and the leak for a score; null labels are left out; a
    null id has a score and is not held out; of several labels for an id the largest counts;
    repeated rows get equal results; other columns aren't read; no rows give none.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_rows=max_rows))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with batch_bytes(spark):
        out = rows.transform(mapped(_scored(model, threshold), "doc_id long, score double, predicted int, n_sentences long, toxic array<struct<start: long, end: long, score: double>>"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_sentences", "toxic")
