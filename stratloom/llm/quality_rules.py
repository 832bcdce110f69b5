"""Quality rules and perplexity bands of a modified Kneser-Ney model.

The model predicts bytes: capitals of A-Z count as small, each white-space byte as a space, and
n-grams have up to ``order`` bytes, eight at most, so a key is an exact 64-bit number.  Spark counts
the n-grams by language, of the texts that pass the rules and have few symbols (what the model is to
reject mustn't teach it); all lower orders follow from these.  The ``LANGUAGES`` commonest languages
have a model each, all others share one.  Keys are in sorted arrays, found by binary search.

A language has some 100,000 distinct 4-grams in alphabetic scripts, a few millions in ideographic ones,
however large the corpus; the levels up to ``ORDER`` are gathered and broadcast.  Those above grow
with the corpus and never meet in one place.  Texts are kept in chunks.  A chunk sends its distinct
n-grams to parts by a hash of the last four bytes before the predicted one, so a part holds all that
the higher levels of its contexts need, and it sends back a logarithm for each of a chunk's n-grams.

Each language gets a band around the middle of its documents' cross-entropy a byte;
what lies below (endless repetition) or above (noise) is rejected.  A band is as wide as
several interquartile ranges plus a term for the noise of short texts, so the clean bulk
of a language stays whole.  The fewer documents a language has, the more its quartiles are
drawn towards those of all languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import Workspace, batch_bytes, mapped

ORDER = 4
HIGHEST = 8
CLASSES = 256
CHUNK = 6 << 20  # bytes of text whose n-grams are sorted at once
PART = 48 << 20  # bytes of text for each part of the higher levels
ROUNDS = 4  # in which chunks get their answers, each of which shuffles its share of them
LANGUAGES = 256
SYMBOLS = b"#*$%&|<>"
CLASS = np.where(X.IS_SPACE, 32, X.LOWER).astype(np.uint8)
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(SYMBOLS)] = 1


def rule_counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """For each document the counts on which the rules stand."""
    starts, _, h = X.words(raw, offsets, lower=False)
    bounds = X.word_bounds(starts, offsets)
    n_words = np.diff(bounds)
    out = {"n_words": n_words}
    out["word_chars"] = X.per_doc((X.codepoints(raw) & ~X.IS_SPACE[raw]).astype(np.uint8), offsets)
    out["n_symbols"] = X.per_doc(_SYMBOL[raw], offsets)
    whole = raw.tobytes()
    dup = np.zeros(len(n_words), np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        lines = whole[a:b].split(b"\n")
        if len(lines) > 1:
            seen, n = set(), 0
            for line in lines:
                if line in seen:
                    n += 1
                elif line.strip():
                    seen.add(line)
            dup[i] = n
    out["n_dup_lines"] = dup
    # words in windows of five that occur twice or more
    m = len(h) - 4
    covered = np.zeros(len(h), np.uint8)
    if m > 0:
        doc = np.repeat(np.arange(len(n_words)), n_words)
        grams = np.zeros(m, X.U)
        for i in range(5):
            grams += h[i : i + m] * X.U(0x9E3779B97F4A7C15 * (2 * i + 1) & 0xFFFFFFFFFFFFFFFF)
        at = np.flatnonzero(doc[:m] == doc[4:])
        keys = X.mix(grams[at] + X.mix(doc[at].astype(X.U) + X.U(1)))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        edge = np.zeros(len(h) + 6, np.int32)
        hit = at[again]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + 5, -1)
        covered = (np.cumsum(edge)[: len(h)] > 0).astype(np.uint8)
    out["n_repeat_words"] = X.per_doc(covered, bounds)
    return out


def packed(raw: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each byte; zeros stand before a document."""
    ids = CLASS[raw]
    key = ids.astype(_kind(order))
    shifted = np.empty_like(key)
    for back in range(1, order):
        shifted[:back] = 0
        shifted[back:] = ids[:-back]
        for i in range(back):  # nothing is seen across the start of a document
            at = offsets[:-1] + i
            shifted[at[(at < offsets[1:])]] = 0
        shifted <<= key.dtype.type(8 * back)
        key |= shifted
    return key


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and the place of each key among them; some three times the memory of
    the keys, where np.unique takes seven times."""
    by = np.argsort(keys)
    keys = keys[by]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    own = keys[new]
    del keys
    at = np.empty(len(by), np.int32 if len(by) < 1 << 31 else np.int64)
    at[by] = np.cumsum(new, dtype=at.dtype) - at.dtype.type(1)
    return own, at


def _kind(order: int):
    """Keys have 32 bits where these do."""
    return np.uint32 if order <= 4 else np.uint64


def suffix(keys: np.ndarray, order: int) -> np.ndarray:
    """The last bytes of n-grams as keys of that order."""
    return (keys & keys.dtype.type((1 << 8 * order) - 1)).astype(_kind(order), copy=False)


def _language(col: pa.Array, known: frozenset) -> np.ndarray:
    """Languages by name; null is '', and all that have no model of their own are None."""
    return np.array([x if (x := y or "") in known else None for y in col.to_pylist()], dtype=object)


def _count(known: frozenset, passing):
    """4-gram counts by language of the texts whose rule counts are passing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang, keys: np.ndarray, n: np.ndarray) -> None:
            if lang in held:
                keys, inverse = np.unique(np.concatenate([held[lang][0], keys]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([held[lang][1], n]).astype(np.float64)).astype(np.int64)
            held[lang] = keys, n

        for batch in batches:
            offsets, raw = X.buffers(batch.column(1))
            langs = _language(batch.column(0), known)
            for i, j in X.slices(offsets):
                part = raw[offsets[i] : offsets[j]]
                own = offsets[i : j + 1] - offsets[i]
                keys = packed(part, own)
                use = passing(rule_counts(part, own))
                sizes = np.diff(own)
                for lang in set(langs[i:j]):
                    mine = np.sort(keys[np.repeat((langs[i:j] == lang) & use, sizes)])
                    if len(mine):
                        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                        add(lang, mine[first], np.diff(np.append(first, len(mine))))
        for lang, (keys, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return run


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 for none."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


def cut(t) -> np.ndarray:
    """Discounts of n-grams seen 0, 1, 2 and 3 or more times; t are the numbers of those seen 1 to 4 times."""
    y = t[0] / (t[0] + 2 * t[1]) if t[0] and t[1] else 0.5
    return np.array([0.0] + [min(max(c - (c + 1) * y * t[c] / t[c - 1], 0.05), c - 0.05) if t[c - 1] and t[c] else 0.5 for c in (1, 2, 3)])


def levels(keys: np.ndarray, counts: np.ndarray, order: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted n-grams and their counts for the orders from ``least`` to ``order``."""
    at = np.argsort(keys)
    out = [(suffix(keys[at], order), counts[at].astype(np.float64))]
    for k in range(order - 1, least - 1, -1):  # a lower order counts the distinct bytes before it
        short, n = np.unique(suffix(out[0][0], k), return_counts=True)
        out.insert(0, (short, n.astype(np.float64)))
    return out


class KneserNey:
    """Interpolated modified Kneser-Ney estimates of one language, from its counts of n-grams of ``order``;
    with the model ``low`` of the lower levels and the discounts of the higher ones, for those
    contexts whose n-grams are all there."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER, low: KneserNey | None = None, cuts: dict[int, np.ndarray] | None = None):
        self.order, self.low = order, low
        self.base = low.order if low else 0
        self.grams, self.logp, self.contexts, self.backoff = [], [], [], []
        below: tuple[np.ndarray, np.ndarray] | None = None
        for k, (grams, n) in enumerate(levels(keys, counts, order, self.base + 1), self.base + 1):
            d = cuts[k] if cuts else cut([float((n == c).sum()) for c in (1, 2, 3, 4)])
            ctx, at = np.unique(grams >> grams.dtype.type(8), return_inverse=True)
            total = np.bincount(at, n)
            own = n - d[np.minimum(n, 3).astype(int)]
            spare = 1 - np.bincount(at, own) / total
            if below is not None:
                under = below[1][np.searchsorted(below[0], suffix(grams, k - 1))]
            else:
                under = np.exp(low.score(suffix(grams, k - 1))) if low else np.full(len(grams), 1.0 / CLASSES)
            p = own / total[at] + spare[at] * under
            self.grams.append(grams)
            self.logp.append(np.log(p))
            self.contexts.append(ctx)
            self.backoff.append(np.log(spare))
            below = grams, p

    def score(self, keys: np.ndarray) -> np.ndarray:
        """ln P(last byte | those before) for packed n-grams."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        for k in range(self.order, self.base, -1):
            own = suffix(keys[todo], k)
            level = k - self.base - 1
            at = find(self.grams[level], own)
            found = at >= 0
            out[todo[found]] += self.logp[level][at[found]]
            todo, own = todo[~found], own[~found]
            if not len(todo):
                return out
            at = find(self.contexts[level], own >> own.dtype.type(8))
            out[todo[at >= 0]] += self.backoff[level][at[at >= 0]]
        out[todo] += self.low.score(suffix(keys[todo], self.base)) if self.low else -np.log(CLASSES)
        return out


def languages(docs: DataFrame, lang_col: str) -> frozenset:
    """The ``LANGUAGES`` commonest ones, ties by name; null counts as ''."""
    counted = docs.groupBy(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang")).agg(F.count("*").alias("n"))
    return frozenset(r["lang"] for r in counted.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect())


def count_grams(docs: DataFrame, text_col: str, lang_col: str, known: frozenset, passing) -> DataFrame:
    """(lang, gram, n) over every text that is passing."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.transform(mapped(_count(known, passing), "lang string, gram long, n long")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str, lang_col: str, known: frozenset, passing) -> dict[str | None, KneserNey]:
    counts = count_grams(docs, text_col, lang_col, known, passing).toArrow()
    langs = np.array(counts["lang"].to_pylist(), dtype=object)
    keys, n = counts["gram"].to_numpy(), counts["n"].to_numpy()
    none = KneserNey(keys[:0], n[:0])
    return {lang: none for lang in (*known, None)} | {lang: KneserNey(keys[langs == lang], n[langs == lang]) for lang in set(langs)}


def _score(models, known: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = models.value
        for batch in batches:
            offsets, raw = X.buffers(batch.column(2))
            langs = _language(batch.column(1), known)
            for i, j in X.slices(offsets):
                part = raw[offsets[i] : offsets[j]]
                own = offsets[i : j + 1] - offsets[i]
                counts = rule_counts(part, own)
                keys = packed(part, own)
                sizes = np.diff(own)
                logp = np.zeros(len(keys))
                for lang in set(langs[i:j]):
                    mine = np.repeat(langs[i:j] == lang, sizes)
                    if mine.any():
                        logp[mine] = held[lang].score(keys[mine])
                entropy = -X.per_doc(logp, own) / np.maximum(sizes, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(langs[i:j], pa.string()), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(sizes.astype(np.int64)), pa.array(entropy)],
                    ["id", "lang", *COUNTS, "n_bytes", "entropy"],
                )

    return run


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _length(blob: bytes) -> int:
    return int.from_bytes(blob[:8], "little")


def _spread(blob: bytes, kind) -> np.ndarray:
    n, kind = _length(blob), np.dtype(kind)
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], n * kind.itemsize, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).reshape(-1).view(kind)


def _joined(blobs: list[bytes], n: int, kind) -> np.ndarray:
    """The n numbers of all blobs."""
    out, at = np.empty(n, kind), 0
    for blob in blobs:
        out[at : at + _length(blob)] = _spread(blob, kind)
        at += _length(blob)
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows with blobs, one at a time."""
    for batch in batches:
        for k in range(len(batch)):
            yield batch.slice(k, 1).to_pylist()[0]


def _chunks(known: frozenset, passing):
    """Texts in chunks, with what the rules count."""
    place = {lang: i for i, lang in enumerate([*sorted(known), None])}

    def give(pile: list) -> pa.RecordBatch:
        ids, langs, raw, sizes = (np.concatenate([x[i] for x in pile]) for i in range(4))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        counts = rule_counts(raw, offsets)
        row = {"ids": ids.tolist(), "langs": langs.tolist(), "sizes": sizes.tolist(), "teach": passing(counts).tolist()} | {c: counts[c].tolist() for c in COUNTS}
        return pa.RecordBatch.from_arrays([*(pa.array([x]) if len(x) else pa.array([x], pa.list_(pa.int64())) for x in row.values()), pa.array([_squeezed(raw)], pa.binary())], [*row, "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pile, held = [], 0
        for batch in batches:
            offsets, raw = X.buffers(batch.column(2))
            ids = np.array(batch.column(0).to_pylist(), dtype=object)
            langs = np.array([place[x] for x in _language(batch.column(1), known)], np.int64)
            for i, j in X.slices(offsets, CHUNK):
                if held and held + offsets[j] - offsets[i] > CHUNK:
                    yield give(pile)
                    pile, held = [], 0
                pile.append((ids[i:j], langs[i:j], raw[offsets[i] : offsets[j]].copy(), np.diff(offsets[i : j + 1])))
                held += int(offsets[j] - offsets[i])
        if pile:
            yield give(pile)

    return run


def _grams(row: dict, order: int, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each language of a chunk: its number, its places, the order of their n-grams, the distinct
    n-grams by part, and where each part's begin."""
    sizes, of = np.array(row["sizes"], np.int64), np.array(row["langs"], np.int16)
    raw = _spread(row["blob"], np.uint8)
    langs = np.repeat(of, sizes)
    for lang in sorted(set(row["langs"])):
        mine = langs == lang
        if mine.any():
            own, inverse = distinct(packed(raw[mine], np.concatenate([[0], np.cumsum(sizes[of == lang])]), order))
            context = (own >> np.uint64(8)) & np.uint64(0xFFFFFFFF)
            part = (X.mix(context * np.uint64(LANGUAGES + 1) + np.uint64(lang)) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            rank = np.empty(len(by), inverse.dtype)
            rank[by] = np.arange(len(by), dtype=inverse.dtype)
            own, first = own[by], np.searchsorted(part[by], np.arange(parts + 1))
            del context, part, by
            inverse = rank[inverse]
            yield lang, mine, inverse, own, first


def _sent(order: int, parts: int):
    """The distinct n-grams of each chunk for each part, and how often they teach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            teach = np.repeat(np.array(row["teach"], bool), np.array(row["sizes"], np.int64))
            for lang, at, rank, own, first in _grams(row, order, parts):
                n = np.bincount(rank[teach[at]], minlength=len(own)).astype(np.uint32)
                used = np.flatnonzero(np.diff(first))
                blocks = [(int(p), slice(first[p], first[p + 1])) for p in used]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.array([lang] * len(used), pa.int32()), pa.array([row["chunk"]] * len(used), pa.int64()), pa.array([_squeezed(own[x]) for _, x in blocks], pa.binary()), pa.array([_squeezed(n[x]) for _, x in blocks], pa.binary())],
                    ["part", "lang", "chunk", "grams", "n"],
                )

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each language of a part: its n-grams, their counts, and where those of each chunk stand."""

    def give(held: list[dict]) -> pa.RecordBatch:
        ends = np.cumsum([_length(x["grams"]) for x in held])
        grams, at = distinct(_joined([x["grams"] for x in held], ends[-1], np.uint64))
        at = np.split(at, ends[:-1])
        n = np.zeros(len(grams), np.int64)
        for x, own in zip(held, at, strict=True):  # a chunk's are distinct
            n[own] += _spread(x["n"], np.uint32)
        steps = [_squeezed(np.diff(x, prepend=0).astype(np.uint32)) for x in at]
        row = [[held[0]["part"]], [held[0]["lang"]], [_squeezed(grams)], [_squeezed(n)], [[x["chunk"] for x in held]], [steps]]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["part", "lang", "grams", "n", "chunks", "steps"])

    held: list[dict] = []
    for row in _rows(batches):
        if held and (held[0]["part"], held[0]["lang"]) != (row["part"], row["lang"]):
            yield give(held)
            held = []
        held.append(row)
    if held:
        yield give(held)


def _taught(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grams, n = _spread(row["grams"], np.uint64), _spread(row["n"], np.int64)
    return grams, grams[n > 0], n[n > 0]


def _tally(order: int):
    """Of the higher levels the numbers of n-grams seen 1 to 4 times, and the counts of the level ``ORDER``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, grams, n = _taught(row)
            if not len(grams):
                continue
            found = levels(grams, n, order, ORDER)
            rows = [(k, c, int((m == c).sum())) for k, (_, m) in enumerate(found[1:], ORDER + 1) for c in (1, 2, 3, 4)]
            level, gram, many = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            low, m = found[0]
            level, gram, many = np.append(level, np.full(len(low), ORDER)), np.append(gram, low.astype(np.int64)), np.append(many, m.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(level), pa.int32()), pa.array(level, pa.int32()), pa.array(gram), pa.array(many)], ["lang", "level", "gram", "n"])

    return run


def _answers(models, order: int, turn: int):
    """For each chunk of a round and each part the logarithms of the chunk's n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            low, cuts = models.value[row["lang"]]
            every, grams, n = _taught(row)
            logp = KneserNey(grams, n, order, low, cuts).score(every).astype(np.float32)
            for chunk, steps in zip(row["chunks"], row["steps"], strict=True):
                if chunk % ROUNDS != turn:
                    continue
                at = np.cumsum(_spread(steps, np.uint32), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([row["lang"]], pa.int32()), pa.array([row["part"]], pa.int32()), pa.array([_squeezed(logp[at])], pa.binary())], ["chunk", "lang", "part", "blob"])

    return run


def _entropies(known: frozenset, order: int, parts: int):
    """Rows of texts from chunks, each followed by its answers by language and part."""
    names = [*sorted(known), None]

    def give(row: dict, answers: list[tuple[int, bytes]]) -> pa.RecordBatch:
        sizes = np.array(row["sizes"], np.int64)
        logp = np.zeros(int(sizes.sum()))
        for lang, at, rank, own, _ in _grams(row, order, parts):
            blobs = [blob for x, blob in answers if x == lang]
            if sum(map(_length, blobs)) != len(own):
                raise ValueError("a chunk misses answers")
            logp[at] = _joined(blobs, len(own), np.float32)[rank]
        entropy = -X.per_doc(logp, np.concatenate([[0], np.cumsum(sizes)])) / np.maximum(sizes, 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(row["ids"], pa.int64()), pa.array([names[x] for x in row["langs"]], pa.string()), *(pa.array(row[c], pa.int64()) for c in COUNTS), pa.array(sizes), pa.array(entropy)],
            ["id", "lang", *COUNTS, "n_bytes", "entropy"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, answers = None, []
        for row in _rows(batches):
            if row["part"] >= 0:
                answers.append((row["lang"], row["blob"]))
                continue
            if held is not None:
                yield give(held, answers)
            held, answers = row, []
        if held is not None:
            yield give(held, answers)

    return run


def distributed(ws: Workspace, rows: DataFrame, known: frozenset, passing, order: int, schema: str) -> DataFrame:
    """(id, lang, counts, n_bytes, entropy) of texts by a model whose levels above ``ORDER`` stay in parts."""
    spark = rows.sparkSession
    lists = "ids array<long>, langs array<long>, sizes array<long>, teach array<boolean>, " + "".join(f"{c} array<long>, " for c in COUNTS)
    chunks = ws.save(rows.transform(mapped(_chunks(known, passing), lists + "blob binary")).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    size = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
    parts = 1 + size // PART
    sent = chunks.transform(mapped(_sent(order, parts), "part int, lang int, chunk long, grams binary, n binary"))
    merged = ws.save(sent.repartition(parts, "part").sortWithinPartitions("part", "lang").transform(mapped(_merged, "part int, lang int, grams binary, n binary, chunks array<long>, steps array<binary>")), "parts")
    ws.release()
    tally = merged.select("lang", "grams", "n").transform(mapped(_tally(order), "lang int, level int, gram long, n long")).groupBy("lang", "level", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, level, gram, n = (tally[c].to_numpy() for c in ("lang", "level", "gram", "n"))
    models = {}
    for x in range(len(known) + 1):
        low = (lang == x) & (level == ORDER)
        cuts = {k: cut([float(n[(lang == x) & (level == k) & (gram == c)].sum()) for c in (1, 2, 3, 4)]) for k in range(ORDER + 1, order + 1)}
        models[x] = KneserNey(gram[low], n[low]), cuts
    models = spark.sparkContext.broadcast(models)
    scored = []
    for turn in range(ROUNDS):
        answers = merged.transform(mapped(_answers(models, order, turn), "chunk long, lang int, part int, blob binary"))
        own = chunks.filter(F.col("chunk") % ROUNDS == turn).withColumns({"lang": F.lit(-1), "part": F.lit(-1)})
        both = own.unionByName(answers, allowMissingColumns=True).repartition(parts, "chunk").sortWithinPartitions("chunk", "lang", "part")
        scored.append(ws.save(both.transform(mapped(_entropies(known, order, parts), schema)), "scored"))
        ws.release()
    ws.drop(chunks, merged)
    return reduce(DataFrame.unionByName, scored)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 10, repeat_percent: int = 20, train_symbols: int = 10, spread: float = 6.0, above: float = 0.9, below: float = 0.5, noise: float = 3.0, prior_docs: float = 50.0, order: int = ORDER
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, entropy, low, high, kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``repeat_percent`` percent
    of the words in repeated 5-word windows.  ``entropy`` is the cross-entropy in nats a
    byte, of a model of ``order`` bytes (up to ``HIGHEST``) that learns from the texts that pass the rules and have at most
    ``train_symbols`` symbols per 100 words; a row is kept if it passes the rules and lies between
    ``low`` and ``high``: the quartiles of those texts in its language, widened by ``spread``
    interquartile ranges (``below`` and ``above`` nats at least, so that a text that mixes
    languages stays) and by ``noise / sqrt(bytes)``.  The quartiles of a language are drawn towards
    those of all languages, which weigh as much as ``prior_docs`` documents, so every
    language has a band, however few its documents; one none of whose texts teach has none, and
    keeps what passes the rules.

    A null or empty text has no words and fails; a null language is a language of its own
    (''); languages beyond the ``LANGUAGES`` commonest count as one; a null id stays null;
    repeated rows get equal results; other columns aren't read; no rows give no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "rules")

    def failing(c):
        return (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > repeat_percent * c["n_words"])

    def teaching(c):
        return ~failing(c) & (100 * c["n_symbols"] <= train_symbols * c["n_words"])

    known = languages(docs, lang_col)
    if not ORDER <= order <= HIGHEST:
        raise ValueError(f"order is {ORDER} to {HIGHEST}")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, lang string, " + "".join(f"{c} long, " for c in COUNTS) + "n_bytes long, entropy double"
    if order > ORDER:
        with batch_bytes(spark):
            scored = distributed(ws, rows, known, teaching, order, schema)
    else:
        models = spark.sparkContext.broadcast(train(docs, text_col, lang_col, known, teaching))
        scored = ws.save(rows.transform(mapped(_score(models, known), schema)), "scored")
    counts = {c: F.col(c) for c in COUNTS}
    failed, teach = failing(counts), teaching(counts)
    quarters = F.percentile_approx("entropy", [0.25, 0.75], 10000)
    own = scored.filter(teach).groupBy("lang").agg(quarters.alias("q"), F.count("*").alias("docs"))
    pooled = scored.filter(teach).agg(quarters.alias("pooled"))  # one row
    drawn = [((F.col("docs") * F.col("q")[i] + prior_docs * F.col("pooled")[i]) / (F.col("docs") + prior_docs)).alias(f"q{2 * i + 1}") for i in (0, 1)]
    band = own.crossJoin(F.broadcast(pooled)).select("lang", *drawn)
    wide, short = spread * (F.col("q3") - F.col("q1")), noise / F.sqrt(F.greatest(F.col("n_bytes"), F.lit(1)))
    band = band.withColumnRenamed("lang", "l")
    return (
        scored.join(F.broadcast(band), F.col("lang").eqNullSafe(F.col("l")), "left")  # a row for each language, as the models on the driver
        .withColumns({"base_failed": failed, "low": F.col("q1") - F.greatest(wide, F.lit(below)) - short, "high": F.col("q3") + F.greatest(wide, F.lit(above)) + short})
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("entropy").between(F.col("low"), F.col("high")), F.lit(True)))
        .select(F.col("id").alias("doc_id"), *COUNTS, "base_failed", "entropy", "low", "high", "kept")
    )
