"""Alignment of two tokenizers over the same bytes.

Both tokenizers cut the bytes of space + text into tokens.  The tokens of B are a static
interval index, two sorted arrays of starts and ends; each token of A stabs it by two bisections
that give the run of B tokens it overlaps.  A gap between B tokens that no A token spans is a
place where both end, and such gaps bound the groups.

How often a pair of ids is linked in the whole corpus is counted by Spark.  Texts go
through the tokenizers once; each leaves a row with its distinct pairs.  Counts of at most
``HOT`` pairs, those above a share of all links, are looked up in the tasks; what a text has
besides them is joined by pair, where no pair has more than that share of the rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import Workspace, batch_bytes, mapped

HOT = 1 << 20
SEGMENT = 1 << 16
BLOCK = 1 << 20


class Vocabulary:
    """The bytes of every id, flat, with starts and lengths."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[ids] - (ends - n), n)
        return self.flat[at]


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the
    others in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


#: A fixed value: how byte-level vocabularies of this kind cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = 0x240  # letters below have had their kind since the first editions of Unicode


class ByteLevel:
    """A tokenizer file with byte-level entries; strings of special tokens count as plain text.

    Where the file has nothing but merges in the order of their ids, the same merges are applied by
    ``tiktoken``, in a third of the time.  It cuts texts by its own tables of Unicode, so only texts of letters
    below ``PLAIN`` go there; the tests hold both to the same ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = _byte_letters()
        entries = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        tokens = [bytes(letters[c] for c in e if c in letters) for e in entries]
        self.vocabulary = Vocabulary(tokens)
        self.merges = self._merges(json.loads(self.tokenizer.to_str()), tokens)

    @staticmethod
    def _merges(spec: dict, tokens: list[bytes]):
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and spec["normalizer"] is None
        if not plain or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if None in made or made != sorted(made) or len(set(made)) + 256 != len(model["vocab"]):
            return None
        import tiktoken

        return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks={tokens[i]: i for i in model["vocab"].values()}, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        rest = []
        for n, t in enumerate(texts):
            if self.merges is not None and len(t) <= 2 * SEGMENT and (t.isascii() or max(t) < chr(PLAIN)):
                out[n] = self.merges.encode_to_numpy(f" {t}", disallowed_special=())
            else:
                rest.append(n)
        if rest:
            for n, e in zip(rest, self.tokenizer.encode_batch_fast([f" {texts[n]}" for n in rest], add_special_tokens=False), strict=True):
                out[n] = np.array(e.ids, np.uint32)
        return out


class Pieces:
    """A sentencepiece model, which puts the space before a text by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.vocabulary = Vocabulary([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        # no piece reaches over the space between two words, so a text may be cut there
        self.by_words = not any("▁" in p.lstrip("▁") for p in names)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.model.encode(texts, num_threads=1)]


@functools.cache
def tokenizers(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a), Pieces(b)


def segments(text: str, most: int = SEGMENT) -> list[str]:
    """text cut at single spaces between an ASCII letter and what is no white space, about every
    ``most`` characters; a text without such a space stays whole.  There a pre-token of A ends, and
    the space is what both tokenizers see before the next segment, so ids don't change."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while len(text) - at > most:
        cut = at + most
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= len(text):
                cut = -1
                break
            if text[cut - 1].isascii() and text[cut - 1].isalpha() and not text[cut + 1].isspace():
                break
            cut += 1
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut + 1
    return [*out, text[at:]]


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.concatenate([np.zeros(0, np.uint32), *lists]).astype(np.int64), sizes


class Aligned:
    """The tokens of some texts, which count one after the other, and what links them.

    ``ok``: texts whose joined tokens of A and of B are both space + text; the others have no
    tokens.  ``ids_a, doc_a, ids_b, doc_b``: tokens with their text.  ``a, b``: the links as
    places of tokens.  ``group_a, group_b``: groups of tokens, numbered throughout."""

    def __init__(self, texts: list[str], first: ByteLevel, second: Pieces):
        n = len(texts)
        cut = [segments(t) if second.by_words else [t] for t in texts]
        parts = [s for c in cut for s in c]
        owner = np.repeat(np.arange(n), [len(c) for c in cut])
        ids_a, size_a = _flat(first.encode(parts))
        ids_b, size_b = _flat(second.encode(parts))
        doc_a, doc_b = np.repeat(owner, size_a), np.repeat(owner, size_b)
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        want = np.array([len(r) + 1 for r in raw], np.int64)
        len_a, len_b = first.vocabulary.length, second.vocabulary.length
        total = lambda doc, ids, length: np.bincount(doc, length[ids], n).astype(np.int64)
        ok = (total(doc_a, ids_a, len_a) == want) & (total(doc_b, ids_b, len_b) == want) & (want > 1)
        keep = np.flatnonzero(ok)
        if len(keep):
            text = np.frombuffer(b"".join(b" " + raw[i] for i in keep), np.uint8)
            doc = np.repeat(keep, want[keep])
            for vocabulary, ids, of in ((first.vocabulary, ids_a, doc_a), (second.vocabulary, ids_b, doc_b)):
                ok[doc[vocabulary.bytes_of(ids[np.isin(of, keep)]) != text]] = False
        self.ok = ok
        in_a, in_b = ok[doc_a], ok[doc_b]
        self.ids_a, self.doc_a, self.ids_b, self.doc_b = ids_a[in_a], doc_a[in_a], ids_b[in_b], doc_b[in_b]
        self._link(len_a[self.ids_a], len_b[self.ids_b])

    def _link(self, len_a: np.ndarray, len_b: np.ndarray) -> None:
        end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
        start_a, start_b = end_a - len_a, end_b - len_b
        low = np.searchsorted(end_b, start_a, "right")  # the first B token that ends behind the start
        high = np.searchsorted(start_b, end_a, "left")  # and the first that starts at the end or later
        runs = high - low
        self.a = np.repeat(np.arange(len(runs)), runs)
        self.b = np.arange(len(self.a)) + np.repeat(low - (np.cumsum(runs) - runs), runs)
        over = runs > 1  # gaps behind B tokens low .. high - 2 are spanned
        step = np.zeros(len(len_b) + 1, np.int64)
        np.add.at(step, low[over], 1)
        np.add.at(step, high[over] - 1, -1)
        ends = np.cumsum(step)[: len(len_b)] == 0
        self.group_b = np.cumsum(ends) - ends
        self.group_a = self.group_b[low] if len(low) else low


_WIDTH = 11


def _written(ids: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Decimal ids, each followed by its mark, as bytes; and how long each is."""
    digits = np.maximum(np.floor(np.log10(np.maximum(ids, 1))).astype(np.int64) + 1, 1)
    place = np.arange(_WIDTH)
    power = digits[:, None] - 1 - place
    out = np.where(power >= 0, ids[:, None] // 10 ** np.maximum(power, 0) % 10 + 48, 0).astype(np.uint8)
    out[np.arange(len(ids)), digits] = mark
    return out[place <= digits[:, None]], digits + 1


class _Writer:
    """``a1,a2|b1;a3|b2,b3`` of every text by a table of written ids."""

    def __init__(self, ids: int):
        every = np.arange(ids, dtype=np.int64)
        text, self.size = _written(every, np.full(ids, 32, np.uint8))
        wide = int(self.size.max()) if ids else 1
        self.table = np.zeros((ids, wide), np.uint8)
        at = np.arange(wide)
        self.table[at < self.size[:, None]] = text

    def write(self, al: Aligned, n: int) -> tuple[bytes, np.ndarray]:
        """The bytes of n texts, and where each ends; each has a last ; too many."""
        ga, gb = al.group_a, al.group_b
        na, nb = len(ga), len(gb)
        at_a = np.arange(na) + np.searchsorted(gb, ga, "left")
        at_b = np.arange(nb) + np.searchsorted(ga, gb, "right")
        ids, mark = np.empty(na + nb, np.int64), np.full(na + nb, 44, np.uint8)
        ids[at_a], ids[at_b] = al.ids_a, al.ids_b
        last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
        mark[at_a[last(ga)]] = 124
        mark[at_b[last(gb)]] = 59
        size = self.size[ids]
        rows = self.table[ids]
        rows[np.arange(len(ids)), size - 1] = mark
        text = rows[np.arange(rows.shape[1]) < size[:, None]].tobytes()
        doc = np.empty(na + nb, np.int64)
        doc[at_a], doc[at_b] = al.doc_a, al.doc_b
        return text, np.cumsum(np.bincount(doc, size, n).astype(np.int64))


@functools.cache
def _writer(ids: int) -> _Writer:
    return _Writer(ids)


def _texts(col: pa.Array) -> list[str]:
    try:
        return [t or "" for t in col.to_pylist()]
    except UnicodeDecodeError:  # bytes that are no UTF-8 make their own text unlike its tokens
        return [(t or b"").decode("utf-8", "replace") for t in col.cast(pa.binary()).to_pylist()]


LINKS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _links(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tokenizers(a, b)
        ids_b = second.vocabulary.size
        writer = _writer(max(first.vocabulary.size, ids_b))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            offsets, _ = X.buffers(batch.column(1))
            for i, j in X.slices(offsets, BLOCK):
                n = j - i
                al = Aligned(_texts(batch.column(1).slice(i, n)), first, second)
                text, ends = writer.write(al, n)
                starts = np.append(0, ends[:-1])
                sha = [hashlib.sha256(text[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                doc = al.doc_a[al.a]
                groups = np.bincount(al.doc_b, np.append(al.group_b[1:] != al.group_b[:-1], True) if len(al.group_b) else None, n).astype(np.int64)
                span = first.vocabulary.size * ids_b
                keys, times = np.unique(doc * span + al.ids_a[al.a] * ids_b + al.ids_b[al.b], return_counts=True)
                cuts = pa.array(np.searchsorted(keys, np.arange(n + 1) * span).astype(np.int32))
                count = lambda x: pa.array(np.bincount(x, minlength=n).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)), batch.column(0).slice(i, n), count(al.doc_a), count(al.doc_b), pa.array(groups), count(doc), pa.array(sha, pa.string()),
                        pa.ListArray.from_arrays(cuts, pa.array(keys % span)), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32))),
                    ],
                    [c.split()[0] for c in LINKS.split(", ")],
                )
                row += n

    return run


PAIRS = 1 << 21


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, t = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(k, kind="stable")
    k, t = k[order], t[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(t, first) if len(first) else t


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by pair, of as many rows as give up to PAIRS pairs."""
    keys, times, held = [], [], 0
    send = lambda k, t: pa.RecordBatch.from_arrays([pa.array(k), pa.array(t)], ["pair", "n"])
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            keys.append(part.column(0).flatten().to_numpy().copy())
            times.append(part.column(1).flatten().to_numpy().astype(np.int64))
            held += len(keys[-1])
            if held > 2 * PAIRS:
                k, t = _summed(keys, times)
                if len(k) > PAIRS:
                    yield send(k, t)
                    k, t = k[:0], t[:0]
                keys, times, held = [k], [t], len(k)
    if keys:
        yield send(*_summed(keys, times))


FOUND = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, pairs array<long>, times array<int>"


def _looked_up(table, ids_b: int):
    """What the pairs of the lookup give; the others stay in pairs and times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = table.value
        for batch in batches:
            lists = batch.column(7)
            pairs, times = lists.flatten().to_numpy(), batch.column(8).flatten().to_numpy().astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy())
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            n = np.where(hit, counts[at], 0) if len(keys) else np.zeros(len(pairs), np.int64)
            ends = np.append(0, np.cumsum(sizes))
            summed = X.per_doc(n * times, ends)
            top = X.per_doc(np.where(hit & (n == best[pairs % ids_b]), times, 0), ends)
            cuts = pa.array(np.append(0, np.cumsum(X.per_doc((~hit).astype(np.int64), ends))).astype(np.int32))
            rest = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (pairs[~hit], times[~hit].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(top), pa.array(summed), batch.column(6), *rest], [c.split()[0] for c in FOUND.split(", ")])

    return run


def align(docs: DataFrame, *, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per input row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``.  ``a``: path of a byte-level tokenizer file, ``b``: of a sentencepiece model.

    Links are all pairs of a token of A and one of B that share bytes.  ``n_best``: links whose
    pair of ids is the most linked one of its B id in all documents, ties included; ``count_sum``:
    the sum over links of how often their pair is linked; ``groups_sha256``: of the groups as
    text, '' without tokens.

    A null or empty text, and one that either tokenizer doesn't give back byte for byte, has no
    tokens: zeros and ''.  Null ids stay null; repeated rows each count and get equal results;
    other columns aren't read; no rows give none.  ``hot`` changes the plan, never a result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "alignment")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids_b = Pieces(b).vocabulary.size
    with batch_bytes(spark):
        links = ws.save(rows.transform(mapped(_links(a, b), LINKS)), "links")
        counts = ws.save(links.select("pairs", "times").transform(mapped(_counted, "pair long, n long")).groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = 1 if total[1] <= hot else total[0] // hot + 1  # at most hot pairs have so many links
    best = counts.groupBy((F.col("pair") % ids_b).alias("b")).agg(F.max("n").alias("best"))
    top = best.toArrow()  # a row for each id of B at most
    most = np.zeros(ids_b, np.int64)
    most[top["b"].to_numpy()] = top["best"].to_numpy()
    often = counts.filter(F.col("n") >= least).toArrow()
    order = np.argsort(often["pair"].to_numpy())
    table = spark.sparkContext.broadcast((often["pair"].to_numpy()[order], often["n"].to_numpy()[order], most))
    with batch_bytes(spark):
        found = links.transform(mapped(_looked_up(table, ids_b), FOUND))
        if least == 1:
            return found.drop("row", "pairs", "times")
        found = ws.save(found, "found")
    ws.drop(links)
    rest = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("t"))
    seldom = counts.filter(F.col("n") < least).join(F.broadcast(best), F.col("pair") % ids_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("best")).alias("top"))
    more = rest.join(seldom, "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("t")).alias("s"), F.sum(F.when(F.col("top"), F.col("t")).otherwise(0)).alias("m"))
    out = found.drop("pairs", "times").join(more, "row", "left")
    plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "m"), plus("count_sum", "s"), "groups_sha256")
