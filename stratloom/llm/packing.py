"""Best-two-fit packing of token sequences.

Which documents have which length doesn't matter to a packing, only how many there are
of each length, and there are at most ``capacity`` lengths.  Spark tokenises and counts
lengths; the driver fills bins on these counts, a bin layout at a time and as often as
the counts allow (a layout ends only when some length runs out, so there are about as
many layouts as lengths, whatever the corpus); Spark deals the places back to the pieces
by their rank within their length.  Ranks are counted within (length, hash bucket), with a
bucket for every ``BUCKET_ROWS`` pieces of a length, so that one which a third of all
pieces have is spread over as many tasks as it takes.

A bin is filled greedily with the longest piece that fits.  Then its smallest piece is
taken out if two others that aren't packed fit the gap more tightly, and the gap is
filled by the pair with the largest sum.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import _text as X
from ._store import Workspace, ids_side, mapped

BUCKET_ROWS = 1 << 10


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Layouts (lengths in a bin, number of such bins) that use up ``counts``."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    out: list[tuple[list[int], int]] = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        free = left.copy()
        layout, gap = [], capacity
        while gap:
            fit = np.flatnonzero(free[1 : gap + 1])
            if not len(fit):
                break
            layout.append(int(fit[-1]) + 1)
            free[layout[-1]] -= 1
            gap -= layout[-1]
        if gap and len(layout) > 1:
            small = layout[-1]
            room = gap + small
            have = np.flatnonzero(free[1:room]) + 1  # the smallest itself stays out meanwhile
            if len(have):
                mate = np.searchsorted(have, room - have, "right") - 1
                ok = mate >= 0
                twin = ok & (have[np.maximum(mate, 0)] == have) & (free[have] < 2)
                mate = np.where(twin, mate - 1, mate)
                ok = mate >= 0
                total = np.where(ok, have + have[np.maximum(mate, 0)], 0)
                best = int(np.argmax(total))
                if total[best] > small:
                    a, b = int(have[best]), int(have[mate[best]])
                    layout[-1:] = [max(a, b), min(a, b)]
        kinds, used = np.unique(layout, return_counts=True)
        times = int((left[kinds] // used).min())
        left[kinds] -= used * times
        out.append((layout, times))


class Plan:
    """Places of the pieces of each length, by rank."""

    def __init__(self, layouts: list[tuple[list[int], int]]):
        slots: dict[int, list[tuple[int, int, list[int]]]] = {}
        bins = 0
        for layout, times in layouts:
            offsets = np.concatenate([[0], np.cumsum(layout)]).tolist()
            own: dict[int, list[int]] = {}
            for length, offset in zip(layout, offsets, strict=False):
                own.setdefault(length, []).append(offset)
            for length, at in own.items():
                slots.setdefault(length, []).append((times * len(at), bins, at))
            bins += times
        self.bins = bins
        self.ends = {k: np.cumsum([x[0] for x in v]) for k, v in slots.items()}
        self.slots = slots

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == length)
            ends, slots = self.ends[length], self.slots[length]
            run = np.searchsorted(ends, ranks[mine], "right")
            for r in np.unique(run).tolist():
                n, first, at = slots[r]
                rows = mine[run == r]
                inner = ranks[rows] - (ends[r] - n)
                sequence[rows] = first + inner // len(at)
                offset[rows] = np.array(at)[inner % len(at)]
        return sequence, offset


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!#$%&()*+,-./:;<=>?@[]^_`{}~")] = True


def _cuts(part: np.ndarray) -> np.ndarray:
    """Places between a letter and a following ASCII mark, or a mark and an ASCII letter, at
    which this kind of tokenizer always splits.  Apostrophes (contractions) and bars (special
    tokens) are left alone."""
    letter, mark = _LETTER[part], _MARK[part]
    after = letter.copy()  # also the letters of Latin-1, which take two bytes
    after[1:] |= (part[:-1] == 0xC3) & (part[1:] != 0x97) & (part[1:] != 0xB7)
    return np.flatnonzero((after[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1


class WordTokens:
    """Ids of whole texts from ids of their distinct words.

    The tokenizer's rules never reach over ASCII white space or the places of ``_cuts``, so a
    text's ids are those of its words in a row.  A distinct word goes through the tokenizer
    once in a worker, whose later tasks find it here, as long as fewer than ``most`` are held.  Words of letters alone make one
    pre-token each and go in long strings; a token that ends one carries the end mark."""

    def __init__(self, path: str, most: int = 1 << 19):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.keys, self.begin, self.size, self.flat = np.zeros(0, X.U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and where each text's begin and how many they are."""
        plain = [i for i, x in enumerate(texts) if x.isalpha()]
        ids: list = []
        size = np.zeros(len(texts), np.int64)
        order: list[int] = []
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            got = np.array(self.tokenizer.encode(" ".join(texts[i] for i in part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) != len(part) or ends[-1] != len(got):  # not one pre-token each after all
                one = [self.tokenizer.encode(texts[i], add_special_tokens=False).ids for i in part]
                got, ends = np.array([t for x in one for t in x], np.uint32), np.cumsum([len(x) for x in one])
            ids.append(got)
            size[part] = np.diff(ends, prepend=0)
            order += part
        rest = [i for i, x in enumerate(texts) if not x.isalpha()]
        if rest:
            one = [x.ids for x in self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)]
            ids.append(np.array([t for x in one for t in x], np.uint32))
            size[rest] = [len(x) for x in one]
            order += rest
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        begin = np.zeros(len(texts), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        return flat, begin, size

    def __call__(self, raw: np.ndarray, offsets: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all documents, each followed by ``end``, and where each begins."""
        whole = raw.tobytes()
        starts, ends, h = X.words(raw, offsets, lower=b"<|" not in whole, also=_cuts)
        bounds = X.word_bounds(starts, offsets)
        if len(self.keys) > self.most:
            self._clear()
        at = np.searchsorted(self.keys, h)
        new = np.ones(len(h), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != h
        if new.any():
            fresh = np.flatnonzero(new)
            keys, first = np.unique(h[fresh], return_index=True)
            first = fresh[first]
            flat, begin, size = self._encode([whole[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            into = np.searchsorted(self.keys, keys)
            self.begin = np.insert(self.begin, into, begin + len(self.flat))
            self.size = np.insert(self.size, into, size)
            self.keys = np.insert(self.keys, into, keys)
            self.flat = np.concatenate([self.flat, flat])
            at = at + np.searchsorted(keys, h)
        per_word, begin, flat = self.size[at], self.begin[at], self.flat
        if end is not None:  # a word of its own after each document
            per_word, begin = np.insert(per_word, bounds[1:], 1), np.insert(begin, bounds[1:], len(flat))
            flat = np.append(flat, np.uint32(end))
            bounds = bounds + np.arange(len(offsets))
        total = np.concatenate([[0], np.cumsum(per_word)])
        take = np.repeat(begin - total[:-1], per_word) + np.arange(total[-1])
        return flat[take], total[bounds]


@functools.lru_cache(maxsize=1)
def worker_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_tokens(path)
        for batch in batches:
            offsets, raw = X.buffers(batch.column(1))
            for i, j in X.slices(offsets):
                ids, at = tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end)
                doc, piece, start, length, crc = [], [], [], [], []
                data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                for d, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    for p, s in enumerate(range(a, b, capacity)):
                        t = min(s + capacity, b)
                        doc.append(d)
                        piece.append(p)
                        start.append(s - a)
                        length.append(t - s)
                        crc.append(zlib.crc32(data[4 * s : 4 * t]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def _place(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.value.place(batch["length"].to_numpy(), batch["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, *, tokenizer: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``tokenizer`` is the path of a tokenizers file that every executor can open.  A document
    is its ids followed by ``end``; only one longer than ``capacity`` is cut, into full
    pieces and a last one.  No sequence holds more than ``capacity`` tokens and pieces stand
    in it without gaps.

    A null or empty text is the token ``end`` alone; a null id stays null; repeated rows are
    packed each; other columns aren't read; no rows give none.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = rows.transform(mapped(_pieces(tokenizer, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    pieces = ws.save(pieces, "pieces")
    total = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = spark.sparkContext.broadcast(Plan(best_two_fit(total, capacity)))
    buckets = spark.createDataFrame([(k, n // BUCKET_ROWS + 1) for k, n in total.items()], "length long, buckets long")
    # the bucket comes from the written row, so that counts and ranks agree whatever runs again
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))
    pieces = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", bucket).drop("buckets")
    own = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(own), F.lit(0))).drop("n")
    base = ws.save(base, "buckets")  # capacity rows and one for each BUCKET_ROWS pieces
    ranked = pieces.withColumn("own", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(ids_side(base), ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("own") - 1)
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.transform(mapped(_place(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
