"""Scoring of texts with a probabilistic suffix tree over words.

A text is its lower-cased words and one end symbol.  The root of the tree is the
distribution of single words, with absolute discounts whose mass goes to the one class of
all unknown words.  A context of the last words becomes a state if it is frequent enough
and its next-word distribution diverges from that of the state of its suffix by more than
its own size explains; a text's next word is scored by the longest state that ends there.
A state names the next words that it has seen often; all others get the suffix state's
probability, scaled to the mass that is left.  So every distribution sums to one.

What can be a context is a word that was seen twice or several words seen ``PAIR`` times in a row
whose suffix is a state (a path from the root is kept whole), and a state names what it saw
twice; no share of the corpus bounds them, so the tree grows with it, up to contexts of
``depth`` words.  It is kept in Spark tables by 64-bit hashes.  The log probability of a word c is

    root(c) + scale(b) + step(b, c) + scale(a, b) + step(a, b, c) + ...

after ... a and b, where a scale is 0 without that state and a step is 0 without that entry,
so a text's score is a sum over its words, pairs, triples and so on, each looked up on its own.
Keys with more than the share ``SHARE`` of all tokens are looked up in the tasks (fewer than
1 / ``SHARE`` of each length), all others meet their values in ranges of the hash, where no
key holds more than that share.  Bitmaps of bounded size keep most keys without a value out
of the shuffles; they let through more, never less, than they have to.

What is shuffled are not rows but blocks of sorted keys, one for each range that a task has
met: differences of keys in as few bytes as they take, a context once for all that came after it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import BATCH_BYTES, SIEVE, Workspace, batch_bytes, mapped, passes, settle, sieve

PAIR = 8
SHARE = 1e-6
BLOCK = 4 << 20
END = X.mix(np.array([X.U(0x656E64)]))[0]
SHIFT = 20
MOST = 1 << 19  # entries that a task holds before it gives them out
PASSES = 2  # over the texts when they are scored, each of which shuffles its share of their keys


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 for none."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end, and where each text's begin."""
    starts, _, h = X.words(raw, offsets)
    bounds = X.word_bounds(starts, offsets)
    return np.insert(h, bounds[1:], END), bounds + np.arange(len(offsets))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    return X.mix(X.mix(a) * X.U(0x9E3779B97F4A7C15) + b)


def levels(h: np.ndarray, bounds: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For contexts of 1 to ``depth`` words: the places that have one, its hash, the hash of
    its last words with the next (one word less) and that of all of them.  ``END`` stands before a text."""
    at, lower = np.arange(len(h)), h
    start = np.zeros(len(h), np.int64)
    start[bounds[:-1]] = bounds[:-1]
    start = np.maximum.accumulate(start)
    for d in range(1, depth + 1):
        if d == 1:
            ctx = np.empty_like(h)
            ctx[1:] = h[:-1]
            ctx[bounds[:-1]] = END
        else:
            at = np.flatnonzero(np.arange(len(h)) - start >= d - 1)
            ctx = lower[at - 1]
        key = paired(ctx, lower[at])
        yield at, ctx, lower[at], key
        whole = np.zeros_like(h)
        whole[at] = key
        lower = whole


def _training(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        offsets, raw = X.buffers(batch.column(0))
        for i, j in X.slices(offsets, BLOCK):
            yield tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _count_words(parts: int):
    """Blocks of words and their counts."""

    def give(pile) -> Iterator[pa.RecordBatch]:
        key, n = merged(*map(np.concatenate, zip(*pile, strict=True)))
        yield from _sent(parts_of(key, parts), lambda a, b: _rising(key[a:b]) + _whole(n[a:b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pile: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for h, _ in _training(batches):
            keys = np.sort(h)
            first, many = _runs(keys)
            pile.append((keys[first], many))
            size += len(first)
            if size > MOST:
                yield from give(pile)
                pile, size = [], 0
        if size:
            yield from give(pile)

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, own in _by_part(batches):
        readers = [Reader(block) for _, _, block in own]
        key, n = merged(*map(np.concatenate, zip(*((r.rising(), r.whole().astype(np.int64)) for r in readers), strict=True)))
        for i in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], ["key", "n"])


def parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (((keys >> X.U(32)) * X.U(parts)) >> X.U(32)).astype(np.int64)


def _whole(values: np.ndarray) -> bytes:
    """Whole numbers in the smallest type that holds them."""
    most = int(values.max()) if len(values) else 0
    w = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return np.array([len(values), w], np.int64).tobytes() + values.astype(f"<u{w}").tobytes()


def _rising(keys: np.ndarray) -> bytes:
    """Sorted keys as differences in as many bytes as the largest takes."""
    steps = np.diff(keys)
    most = int(steps.max()) if len(steps) else 0
    w = max((most.bit_length() + 7) // 8, 1)
    low = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w]
    return np.array([len(keys), w], np.int64).tobytes() + keys[:1].astype("<u8").tobytes() + low.tobytes()


class Reader:
    """Arrays out of a block of bytes, in the order in which they went in."""

    def __init__(self, block: bytes):
        self.block, self.at = block, 0

    def raw(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.block, kind, n, self.at)
        self.at += out.nbytes
        return out

    def whole(self) -> np.ndarray:
        n, w = self.raw("<i8", 2).tolist()
        return self.raw(f"<u{w}", n)

    def rising(self) -> np.ndarray:
        n, w = self.raw("<i8", 2).tolist()
        if not n:
            return np.zeros(0, X.U)
        first = self.raw("<u8", 1)
        steps = np.zeros((n - 1, 8), np.uint8)
        steps[:, :w] = self.raw("u1", (n - 1) * w).reshape(-1, w)
        return np.cumsum(np.concatenate([first, steps.view("<u8").ravel()]), dtype=X.U)


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key begins and how often it stands there."""
    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(sorted_keys)))


def merged(key: np.ndarray, n: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order with the sums of n, and the others of each key's first row."""
    order = np.argsort(key)
    first, _ = _runs(key[order])
    return key[order][first], np.add.reduceat(n[order], first) if len(first) else n[:0], *(x[order][first] for x in others)


def _sent(part: np.ndarray, block, kind: int = 0, row: int = 0) -> Iterator[pa.RecordBatch]:
    """A record of block(from, to) for each run of equal parts, a few at a time, of some ``BATCH_BYTES`` at most."""

    def records(at: list[int], blocks: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(part[at]), pa.array([kind] * len(at), pa.int32()), pa.array([row] * len(at), pa.int64()), pa.array(blocks, pa.binary())], ["part", "kind", "row", "block"]
        )

    at, blocks, size = [], [], 0
    for a, m in zip(*(x.tolist() for x in _runs(part)), strict=True):
        at.append(a)
        blocks.append(block(a, a + m))
        size += len(blocks[-1])
        if len(at) == 64 or size > BATCH_BYTES:
            yield records(at, blocks)
            at, blocks, size = [], [], 0
    if at:
        yield records(at, blocks)


BLOCKS = "part long, kind int, row long, block binary"


RARE = (1 << 24) - 1  # the code of what isn't frequent


def places(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """As ``find``, each distinct key once and in order, which is kind to the cache."""
    order = np.argsort(keys)
    first, many = _runs(keys[order])
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(find(table, keys[order[first]]), many)
    return out


def _codes(at: np.ndarray, keys: np.ndarray) -> bytes:
    """Places among the frequent keys in three bytes each, and the other keys as they are."""
    low = np.where(at >= 0, at, RARE).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return np.array([len(keys)], "<i8").tobytes() + low.tobytes() + keys[at < 0].astype("<u8").tobytes()


def _decoded(r: "Reader", frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and their places among the frequent ones, -1 for none."""
    n = int(r.raw("<i8", 1)[0])
    wide = np.zeros((n, 4), np.uint8)
    wide[:, :3] = r.raw("u1", 3 * n).reshape(-1, 3)
    at = wide.view("<u4").ravel().astype(np.int64)
    rare = at == RARE
    keys = np.empty(n, X.U)
    keys[rare] = r.raw("<u8", int(rare.sum()))
    keys[~rare] = frequent[at[~rare]] if len(frequent) else 0
    return keys, np.where(rare, -1, at)


def _count_level(level: int, parts: int, held, model):
    """Blocks of (context, last words and next, count), of the contexts that pass the sieve: kind 0 by
    ranges of contexts, kind 1 of the frequent ones, by ranges of the hash of all."""

    def give(key, c, q, n) -> Iterator[pa.RecordBatch]:
        contexts, _, lower, _ = model.value
        key, n, c, q = merged(key, n, c, q)
        at, of_q = places(contexts, c), places(lower, q)
        hot = at >= 0
        for kind, mine in enumerate((np.flatnonzero(~hot), np.flatnonzero(hot))):
            if kind:
                part = parts_of(key[mine], parts)
                mine = mine[np.argsort((part << 24) | at[mine])]
                part, ctx = parts_of(key[mine], parts), at[mine].astype(X.U)
            else:
                mine = mine[np.argsort(c[mine])]
                part, ctx = parts_of(c[mine], parts), c[mine]

            def block(a: int, b: int) -> bytes:
                first, many = _runs(ctx[a:b])  # noqa: B023
                return _rising(ctx[a:b][first]) + _whole(many) + _whole(n[mine[a:b]]) + _codes(of_q[mine[a:b]], q[mine[a:b]])  # noqa: B023

            yield from _sent(part, block, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pile: list[tuple] = []
        size = 0
        for h, bounds in _training(batches):
            for _, c, q, key in levels(h, bounds, level):
                pass
            if held is not None:
                use = passes(held.value, c)
                key, c, q = key[use], c[use], q[use]
            key, n, c, q = merged(key, np.ones(len(key), np.int64), c, q)
            pile.append((key, c, q, n))
            size += len(key)
            if size > MOST:
                yield from give(*map(np.concatenate, zip(*pile, strict=True)))
                pile, size = [], 0
        if size:
            yield from give(*map(np.concatenate, zip(*pile, strict=True)))

    return run


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, int, bytes]]]]:
    """The records of each part, which stand together."""
    rows = ((p, k, r, x.as_py()) for b in batches for p, k, r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True))
    for part, own in itertools.groupby(rows, key=lambda x: x[0]):
        yield part, ((k, r, x) for _, k, r, x in own)


def _counted(model):
    """(c, q, n, key, t, below) of what was seen twice: t is the count of the context, below the log10
    probability under the suffix state where that is at hand, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, count, lower, below = model.value
        for _, own in _by_part(batches):
            piles: tuple[list, list] = ([], [])
            for kind, _, block in own:
                r = Reader(block)
                c = np.repeat(r.rising(), r.whole())
                n = r.whole().astype(np.int64)
                piles[kind].append((c, n, *_decoded(r, lower)))
            for kind, pile in enumerate(piles):
                if not pile:
                    continue
                c, n, q, at = map(np.concatenate, zip(*pile, strict=True))
                if kind:
                    t, c = count[c.astype(np.int64)], contexts[c.astype(np.int64)]
                else:  # all that came after a context is here
                    ctx, total = merged(c, n)
                    t = total[np.searchsorted(ctx, c)]
                key, n, c, q, at, t = merged(paired(c, q), n, c, q, at, t)
                keep = np.flatnonzero(n >= 2)
                for i in range(0, len(keep), 1 << 16):
                    k = keep[i : i + (1 << 16)]
                    p = below[np.maximum(at[k], 0)] if len(below) else np.zeros(len(k))
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[k].view(np.int64)) for x in (c, q, n, key, t)), pa.array(p, mask=at[k] < 0)], ["c", "q", "n", "key", "t", "below"])

    return run


def slots(spark, partitions: int) -> list[int]:
    """For each shuffle partition a number that a repartition brings to it."""
    hashed = spark.range(64 * partitions).groupBy(F.pmod(F.hash("id"), F.lit(partitions)).alias("p")).agg(F.min("id").alias("id"))
    found = {r["p"]: r["id"] for r in hashed.collect()}
    return [found.get(p, p) for p in range(partitions)]


def dealt(blocks: DataFrame, to: list[int]) -> DataFrame:
    """Each range of keys in a partition of its own, records of a kind together."""
    slot = F.array(*(F.lit(x).cast("long") for x in to))[F.col("part")]
    return blocks.withColumn("slot", slot).repartition(len(to), "slot").drop("slot").sortWithinPartitions("part", "kind")


def _states(entries: DataFrame, ctx: str) -> DataFrame:
    """(ctx, weight, scale) of the contexts that diverge from their suffix state; entries
    have ``n``, the context's ``t`` and the log10 probability ``below`` of the suffix state."""
    s = entries.groupBy(ctx).agg(
        F.count("*").alias("kinds"),
        F.sum("n").alias("named"),
        F.max("t").alias("t"),
        F.least(F.sum(F.pow(F.lit(10.0), F.col("below"))), F.lit(1 - 1e-9)).alias("mass"),
        F.sum(F.col("n") * (F.log(F.col("n") / F.col("t")) - float(np.log(10)) * F.col("below"))).alias("gain"),
    )
    rest, left = F.col("t") - F.col("named"), 1 - F.col("mass")
    gain = F.col("gain") + F.when(rest > 0, rest * F.log(rest / F.col("t") / left)).otherwise(0.0)
    weight = F.col("kinds") + 1.0  # of the suffix state's distribution
    return s.filter(gain > 0.5 * weight * F.log(F.greatest(F.col("t"), F.lit(2)))).select(ctx, "t", weight.alias("weight"), F.log10((rest / left + weight) / (F.col("t") + weight)).alias("scale"))


def _named():
    """log10 probability of an entry in its state."""
    return F.log10((F.col("n") + F.col("weight") * F.pow(F.lit(10.0), F.col("below"))) / (F.col("t") + F.col("weight")))


class SuffixTree:
    """The tree of a small corpus in memory, against which the tables are held: states of one
    and two words over a root.  ``root``: log10 probabilities of the symbols.
    Each level has sorted contexts with the log10 scale of what they don't name, and sorted
    (context, symbol) keys with log10 probabilities."""

    def __init__(self, symbols: np.ndarray, root: np.ndarray):
        self.symbols, self.root = symbols, root
        none = np.zeros(0, np.int64)
        self.pairs = none
        self.scale = [np.zeros(len(symbols) + 1), np.zeros(0)]  # by code; by place in pairs
        self.state = [np.zeros(len(symbols) + 1, bool), np.zeros(0, bool)]
        self.keys = [none, none]
        self.logp = [np.zeros(0), np.zeros(0)]

    def grow(self, level: int, keys: np.ndarray, n: np.ndarray, total: np.ndarray) -> None:
        """Adds the states among the contexts 0 .. len(total) - 1 of a level."""
        order = np.argsort(keys)
        keys, n = keys[order], n[order].astype(np.float64)
        ctx, symbol = keys >> SHIFT, keys & ((1 << SHIFT) - 1)
        below = self._below(level, ctx, symbol)
        kinds = np.bincount(ctx, minlength=len(total))
        named = np.bincount(ctx, n, len(total))
        mass = np.clip(np.bincount(ctx, 10.0**below, len(total)), 0, 1 - 1e-9)
        rest, t = total - named, np.maximum(total, 1)
        gain = np.bincount(ctx, n * (np.log(n / t[ctx]) - np.log(10) * below), len(total))
        gain = gain + np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / t / (1 - mass)), 0)
        keep = (kinds > 0) & (gain > 0.5 * (kinds + 1) * np.log(np.maximum(total, 2)))
        if level == 1:
            keep &= self.state[0][self.pairs & ((1 << SHIFT) - 1)]
        weight = kinds + 1.0  # of the suffix state's distribution
        self.state[level] = keep
        self.scale[level] = np.where(keep, np.log10((rest / (1 - mass) + weight) / (total + weight)), 0.0)
        held = keep[ctx]
        self.keys[level] = keys[held]
        self.logp[level] = np.log10((n + weight[ctx] * 10.0**below) / (total + weight)[ctx])[held]

    def _below(self, level: int, ctx: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if level == 0:
            return self.root[symbol]
        return self._one(self.pairs[ctx] & ((1 << SHIFT) - 1), symbol)

    def _one(self, one: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        at = find(self.keys[0], (one << SHIFT) | symbol)
        return np.where(at >= 0, self.logp[0][np.maximum(at, 0)] if len(self.logp[0]) else 0.0, self.root[symbol] + self.scale[0][one])

    def score(self, code: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """For symbols their log10 probability after the contexts; for other words (code -1)
        the log10 factor on their probability at the root."""
        out = np.where(code >= 0, self.root[np.maximum(code, 0)] if len(self.root) else 0.0, 0.0)
        has = one >= 0
        has[has] = self.state[0][one[has]]
        at = np.flatnonzero(has)
        out[at] += self.scale[0][one[at]]
        named = at[code[at] >= 0]
        k = find(self.keys[0], (one[named] << SHIFT) | code[named])
        out[named[k >= 0]] = self.logp[0][k[k >= 0]]
        if len(self.pairs):
            at = at[two[at] >= 0]
            p = find(self.pairs, (two[at] << SHIFT) | one[at])
            at, p = at[p >= 0], p[p >= 0]
            at, p = at[self.state[1][p]], p[self.state[1][p]]
            out[at] += self.scale[1][p]
            named = code[at] >= 0
            at, p = at[named], p[named]
            k = find(self.keys[1], (p << SHIFT) | code[at])
            out[at[k >= 0]] = self.logp[1][k[k >= 0]]
        return out


class Root:
    """Discounted probabilities of single words from their counts."""

    def __init__(self, total: int, of_counts: list[int], types: int):
        n1, n2, n3, n4 = (float(x) for x in of_counts)
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.5, 3 - 4 * y * n4 / n3 if n3 else 0.5]
        self.cut = [min(max(x, 0.05), 0.95 * (i + 1)) for i, x in enumerate(raw)]
        self.total = max(total, 1)
        spare = n1 * self.cut[0] + n2 * self.cut[1] + max(types - n1 - n2, 0) * self.cut[2]
        self.unknown = float(np.log10(max(spare, 1e-9) / self.total)) if total else 0.0

    def log(self, n: np.ndarray) -> np.ndarray:
        cut = np.array([0.0, *self.cut])[np.clip(n, 0, 3).astype(int)]
        return np.where(n > 0, np.log10(np.maximum(n - cut, 1e-9) / self.total), self.unknown)

    def column(self, c):
        cut = F.when(c == 1, self.cut[0]).when(c == 2, self.cut[1]).otherwise(self.cut[2])
        return F.when(c > 0, F.log10((c - cut) / float(self.total))).otherwise(F.lit(self.unknown))


def _requests(model, depth: int, parts: int):
    """Blocks of the keys of texts that aren't held in the task (kind 1 words, 2 others), and
    of what is known of each text (kind 3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        common, is_word, base, value, bits = model.value
        row = TaskContext.get().partitionId() << 40  # all blocks of a text are written by one task
        for batch in batches:
            offsets, raw = X.buffers(batch.column(1))
            ids = batch.column(0)
            for i, j in X.slices(offsets, BLOCK):
                docs = j - i
                h, bounds = tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sizes = np.diff(bounds)
                doc = np.repeat(np.arange(docs), sizes)
                sums = np.zeros((3, docs))
                rare: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # distinct keys, how often, texts
                for level, (own, keys) in enumerate([(doc, h), *((doc[at], key) for at, _, _, key in levels(h, bounds, depth))]):
                    order = np.argsort(keys)
                    first, many = _runs(keys[order])
                    own, keys = own[order], keys[order[first]]
                    k = find(common, keys)
                    held = k >= 0
                    every, k = own[np.repeat(held, many)], np.repeat(k[held], many[held])
                    for out, values in zip(sums, (is_word, base, value), strict=True):
                        out += np.bincount(every, values[k], docs)
                    left = ~held & passes(bits, keys) if level else ~held
                    rare.append((keys[left], many[left], own[np.repeat(left, many)]))
                for kind, (keys, many, own) in zip((1, *[2] * depth), rare, strict=True):
                    ends = np.append(0, np.cumsum(many))

                    def block(a: int, b: int) -> bytes:
                        return _rising(keys[a:b]) + _whole(many[a:b]) + _whole(own[ends[a] : ends[b]])  # noqa: B023

                    yield from _sent(parts_of(keys, parts), block, kind, row)
                known = ids.slice(i, docs)
                null = np.array([not x.is_valid for x in known], np.uint8)
                about = known.fill_null(0).to_numpy().astype("<i8").tobytes() + null.tobytes() + sizes.astype("<i8").tobytes() + sums.astype("<f8").tobytes()
                yield from _sent(np.array([row % parts]), lambda a, b: np.array([docs], "<i8").tobytes() + about, 3, row)  # noqa: B023
                row += docs

    return run


def summed(key: np.ndarray, word: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each key, with the sum of its scores (a step and a scale)."""
    order = np.argsort(key)
    first, _ = _runs(key[order])
    if not len(first):
        return key, word, score
    return key[order][first], np.maximum.reduceat(word[order], first), np.add.reduceat(score[order], first)


def _value_blocks(parts: int):
    """Blocks of values (kind 0); ``n`` is 0 for what is no word."""

    def give(pile) -> Iterator[pa.RecordBatch]:
        key, n, score = map(np.concatenate, zip(*pile, strict=True))
        order = np.argsort(key)
        key, n, score = key[order], n[order], score[order]
        yield from _sent(parts_of(key, parts), lambda a, b: _rising(key[a:b]) + _whole(n[a:b]) + score[a:b].astype("<f8").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pile: list[tuple] = []
        size = 0
        for b in batches:
            key, n, score = (b.column(x).to_numpy(zero_copy_only=False) for x in ("key", "n", "score"))
            pile.append((key.view(X.U), n, score))
            size += len(key)
            if size > MOST:
                yield from give(pile)
                pile, size = [], 0
        if size:
            yield from give(pile)

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of the sieve of the values that are no words, one for each part."""
    for _, own in _by_part(batches):
        found = []
        for _, _, block in own:
            r = Reader(block)
            key = r.rising()
            found.append((key[r.whole() == 0] >> X.U(64 - SIEVE)).astype(np.int64))
        place = np.concatenate(found)
        if len(place):
            first = int(place.min()) >> 6
            flags = np.zeros(((int(place.max()) >> 6) - first + 1) << 6, np.uint8)
            flags[place - (first << 6)] = 1
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["first", "bits"])


def _answers(unknown: float):
    """For each block of texts the sums over the keys that lie in a range (kind 4), and what is
    known of the texts (kind 3).  A task adds up its ranges, for ``MOST`` texts at a time."""

    def give(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for row, found in sums.items():
            docs = np.flatnonzero(found[0])
            yield record(row, 4, _whole(docs) + _whole(found[1][docs].astype(np.int64)) + found[2:, docs].astype("<f8").tobytes())

    def record(row: int, kind: int, block: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row]), pa.array([kind], pa.int32()), pa.array([row]), pa.array([block], pa.binary())], ["part", "kind", "row", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        size = 0
        for _, own in _by_part(batches):
            pile = [(np.zeros(0, X.U), np.zeros(0, np.int64), np.zeros(0))]
            table = None
            for kind, row, block in own:
                r = Reader(block)
                if kind == 0:
                    key = r.rising()
                    n = r.whole().astype(np.int64)
                    pile.append((key, n, r.raw("<f8", len(key))))
                    continue
                if kind == 3:
                    yield record(row, kind, block)
                    continue
                if table is None:
                    table = summed(*map(np.concatenate, zip(*pile, strict=True)))
                    pile = []
                keys, many = r.rising(), r.whole()
                at = find(table[0], keys)
                has = at >= 0
                n, score = np.zeros(len(keys), np.int64), np.full(len(keys), unknown if kind == 1 else 0.0)
                n[has], score[has] = table[1][at[has]], table[2][at[has]]
                doc = r.whole().astype(np.int64)
                width = int(doc.max()) + 1
                if row not in sums or sums[row].shape[1] < width:
                    wide = np.zeros((4, width))
                    if row in sums:
                        wide[:, : sums[row].shape[1]] = sums[row]
                        size -= sums[row].shape[1]
                    sums[row] = wide
                    size += width
                out = sums[row]
                out[0, :width] += np.bincount(doc)
                out[3, :width] += np.bincount(doc, np.repeat(score, many))
                if kind == 1:
                    out[1, :width] += np.bincount(doc, np.repeat(n > 0, many))
                    out[2, :width] += np.bincount(doc, np.repeat(np.log10(n + 1.0), many))
                if size > MOST:
                    yield from give(sums)
                    sums, size = {}, 0
        yield from give(sums)

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text of a block."""
    for _, own in _by_part(batches):
        for kind, _, block in own:
            r = Reader(block)
            if kind == 3:  # comes first
                docs = int(r.raw("<i8", 1)[0])
                ids, null, sizes, sums = r.raw("<i8", docs), r.raw("u1", docs), r.raw("<i8", docs), r.raw("<f8", 3 * docs).reshape(3, docs).copy()
                continue
            at = r.whole().astype(np.int64)
            sums[0][at] += r.whole()
            sums[1:, at] += r.raw("<f8", 2 * len(at)).reshape(2, len(at))
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array(sizes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["id", "n", "known", "base", "score"])


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, depth: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score``.

    Trained on the rows whose crc32(doc_id as text) mod ``folds`` is not ``fold``.  ``base_score``
    is the add-one unigram log10 probability, ``score`` the suffix tree's, with contexts of up to
    ``depth`` words; both are over the training words and one class of unknown words.

    A null or empty text is its end token alone; a row with a null id counts as training
    text and is not held out; repeated rows get equal results; other columns aren't read; no
    rows give none.  Without training rows every word is of the unknown class, with the
    log10 probability 0.
    """
    with batch_bytes(docs.sparkSession):  # what is returned reads written rows and goes through no Python
        return _score_texts(docs, id_col, text_col, folds, fold, depth)


def _score_texts(docs: DataFrame, id_col: str, text_col: str, folds: int, fold: int, depth: int) -> DataFrame:
    spark = docs.sparkSession
    ws = Workspace(spark, "suffix")
    settle(spark)
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    to = slots(spark, partitions)
    parts = len(to)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
    training = rows.filter(~held_out).select("text")
    vocab = ws.save(dealt(training.transform(mapped(_count_words(parts), BLOCKS)), to).transform(mapped(_word_counts, "key long, n long")), "words")
    head = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types"), *(F.coalesce(F.sum((F.col("n") == k).cast("long")), F.lit(0)).alias(f"n{k}") for k in range(1, 5))).first()
    total, types = int(head["tokens"]), int(head["types"])
    root = Root(total, [head[f"n{k}"] for k in range(1, 5)], types)
    bound = max(1, int(SHARE * total))  # fewer than 1 / SHARE keys of each length have more

    def frequent(table: DataFrame, key: str, n: str, value: str) -> tuple[np.ndarray, np.ndarray]:
        got = table.filter(F.col(n) > bound).select(key, value).toArrow()
        keys, values = got[key].to_numpy().view(X.U), got[value].to_numpy()
        order = np.argsort(keys)
        return keys[order], values[order]

    lower = vocab.select("key", "n", root.column(F.col("n")).alias("below"))
    no = F.lit(0).cast("long").alias("word")
    contexts, used = vocab.select(F.col("key").alias("c"), F.col("n").alias("t")), []
    values = [lower.select("key", "n", F.col("n").alias("word"), F.col("below").alias("score"))]
    for level in range(1, depth + 1):
        settle(spark)
        held = spark.sparkContext.broadcast(sieve(contexts, "c")) if level > 1 else None
        model = spark.sparkContext.broadcast((*frequent(contexts, "c", "t", "t"), *frequent(lower, "key", "n", "below")))
        blocks = training.transform(mapped(_count_level(level, parts, held, model), BLOCKS))
        counted = ws.save(dealt(blocks, to).transform(mapped(_counted(model), "c long, q long, n long, key long, t long, below double")), "counted")
        for b in (model, held):
            if b is not None:
                b.destroy()
        ws.release()
        rest = counted.filter("below is null").drop("below").join(lower.select(F.col("key").alias("q"), "below"), "q")
        rest = ws.save(rest.select(counted.columns), "rest")
        ws.release()
        entries = counted.filter("below is not null").union(rest)
        if level > 1:  # the sieve lets some through that are no contexts
            entries = ws.save(entries.join(contexts.select("c"), "c", "left_semi").select(counted.columns), "entries")
            ws.drop(counted, rest)
            counted, rest = entries, entries
        states = ws.save(_states(entries, "c"), "states")
        values.append(states.select(F.col("c").alias("key"), F.col("t").alias("n"), no, F.col("scale").alias("score")))
        has = F.col("weight").isNotNull()
        table = entries.join(states.drop("t"), "c", "inner" if level == depth else "left").select("key", "q", "n", F.when(has, _named()).otherwise(F.col("below")).alias("below"), F.when(has, _named() - F.col("scale") - F.col("below")).otherwise(0.0).alias("step"))
        table = ws.save(table, "level")
        ws.drop(counted, rest)
        ws.release()
        used += [table, states]
        lower = table.select("key", "n", "below")
        values.append(table.filter("step != 0").select("key", "n", no, F.col("step").alias("score")))
        if level < depth:
            contexts = ws.save(table.filter(F.col("n") >= PAIR).join(states.select(F.col("c").alias("q")), "q", "left_semi").select(F.col("key").alias("c"), F.col("n").alias("t")), "contexts")
            used.append(contexts)
    settle(spark)
    values = reduce(DataFrame.union, values)  # a key's step and its scale are rows of their own
    held = values.filter(F.col("n") > bound).toArrow()
    common, count, value = summed(held["key"].to_numpy().view(X.U), held["word"].to_numpy(), held["score"].to_numpy())
    rest = values.filter(F.col("n") <= bound).select("key", F.col("word").alias("n"), "score")
    values = ws.save(dealt(rest.transform(mapped(_value_blocks(parts), BLOCKS)), to), "values")
    ws.drop(vocab, *used)
    ws.release()
    bits = np.zeros(1 << (SIEVE - 6), X.U)
    found = values.transform(mapped(_bits, "first long, bits binary")).toArrow()  # 16 MB in all
    for first, some in zip(found["first"].to_pylist(), found["bits"], strict=True):
        some = np.frombuffer(some.as_buffer(), X.U)
        bits[first : first + len(some)] |= some
    del found
    model = spark.sparkContext.broadcast((common, count > 0, np.log10(count + 1.0), value, bits))
    scored = []
    for turn in range(PASSES):
        settle(spark)
        texts = rows.filter(F.pmod(F.xxhash64("id"), F.lit(PASSES)) == turn)
        blocks = texts.transform(mapped(_requests(model, depth, parts), BLOCKS)).union(values)
        sums = dealt(blocks, to).transform(mapped(_answers(root.unknown), BLOCKS)).repartition(partitions, "part").sortWithinPartitions("part", "kind")
        scored.append(ws.save(sums.transform(mapped(_totals, "id long, n long, known long, base double, score double")), "scored"))
        ws.release()
    model.destroy()
    ws.drop(values)
    out = reduce(DataFrame.union, scored)
    return out.select(
        F.col("id").alias("doc_id"),
        held_out.alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n") * float(np.log10(total + types + 1))).alias("base_score"),
        "score",
    )
