"""Benchmark decontamination by the q-gram lemma.

Texts are compared byte for byte after capitals of A-Z and Latin-1 became small and every run of
white space (no-break spaces included) one space; a map leads back to places of the original.
Each benchmark item is cut into overlapping windows.  A stretch of a document that lies within e
edits of a window of length w shares at least w - q + 1 - q * e of its q-grams with it, on
diagonals (place in the document minus place in the item) that differ by e at most.  Shared
q-grams are counted in half-overlapping bands of diagonals; bands that meet the bound propose
regions, and all alignments of the window within the edit budget there are contamination.

Pairs of equal q-grams are counted a bounded number at a time.  Where a text and the items repeat
themselves (ruled lines, say), the q-grams that make most pairs are left out, and a window that
has fewer of them than its bound is held to what is left of the bound.  The few windows made of
nothing else are aligned with all stretches of the text that are dense in their q-grams.  Either way
every alignment within the budget lies in a proposed region, and spans follow from these
alignments alone: what is counted how, and what else a batch holds, changes none.

The index of the benchmark goes to all executors in blocks of at most ``BLOCK_BYTES`` of
benchmark text, one block after another, so its size is bounded whatever the benchmark's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import Workspace, mapped

Q = 10
WINDOW = 64
STRIDE = 8
RATE = 16  # an edit for so many bytes
EXACT = 32  # shorter items allow no edit
BLOCK_BYTES = 4 << 20
PAIRS = 1 << 23  # of equal q-grams in a block of text, before the commonest are left out
AT_ONCE = 1 << 17
CELLS = 1 << 19  # of alignments at once
DENSE = 64
_BITS = 22


def normal(raw: np.ndarray) -> np.ndarray:
    """Small letters and spaces, every byte in its place."""
    out = X.LOWER[raw]
    if len(out) > 1:
        capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        out[1:][capital] += 32  # capitals of Latin-1, in their two bytes
        wide = np.flatnonzero((raw[:-1] == 0xC2) & (raw[1:] == 0xA0))
        out[wide] = out[wide + 1] = 32
    return np.where(X.IS_SPACE[out], np.uint8(32), out)


def collapsed(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents with runs of spaces as one, their offsets, and the place of each byte kept."""
    space = text == 32
    keep = np.ones(len(text), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][offsets[:-1] < len(text)]] = True
    place = np.flatnonzero(keep)
    return text[place], np.searchsorted(place, offsets), place


def qgrams(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q bytes from each place on."""
    n = max(0, len(text) - Q + 1)
    h = np.zeros(n, X.U)
    for i in range(Q):
        h = h * X.U(0x9E3779B97F4A7C15) + text[i : i + n] + X.U(1)
    return X.mix(h)


def _plain(text: bytes) -> bytes:
    raw = normal(np.frombuffer(text, np.uint8))
    return collapsed(raw, np.array([0, len(raw)]))[0].tobytes().strip(b" ")


def _word(byte: int) -> bool:
    return byte >= 128 or chr(byte).isalnum()


class Index:
    """Windows of the items of a block and where each of their q-grams stands."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids = np.array(ids, np.int64)
        self.texts = [_plain(t) for t in texts]
        self.lines: dict[bytes, list[int]] = {}  # items shorter than a q-gram
        keys, item, place, flat = [], [], [], []
        for i, raw in enumerate(self.texts):
            size = len(raw)
            if size < Q:
                if size:
                    self.lines.setdefault(raw, []).append(i)
                continue
            w = min(WINDOW, size)
            e = w // RATE if size >= EXACT else 0
            flat += [(i, s, s + w - Q, w - Q + 1 - Q * e, e) for s in sorted({*range(0, size - w + 1, STRIDE), size - w})]
            g = qgrams(np.frombuffer(raw, np.uint8))
            keys.append(g)
            item.append(np.full(len(g), i, np.int32))
            place.append(np.arange(len(g), dtype=np.int32))
        none = np.zeros(0, np.int32)
        key, item, place = (np.concatenate(x) if x else none for x in (keys, item, place))
        order = np.argsort(key, kind="stable")
        key, self.item, self.place = key[order].astype(X.U), item[order], place[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else none
        self.key, self.first, self.count = key[first], first.astype(np.int32), np.diff(np.append(first, len(key))).astype(np.int32)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(key >> X.U(64 - _BITS)).astype(np.int64)] = True
        #: of each window: item, first and last place of its q-grams, shared q-grams, edits
        self.flat = np.array(flat, np.int32).reshape(-1, 5)
        self.wide = max(map(len, self.texts), default=0) + 1
        self._ends = None

    def windows(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of listed q-grams the windows that they lie in: a run, as windows stand in order."""
        if self._ends is None:  # made where it is used
            own = self.flat[:, 0].astype(np.int64) * self.wide
            self._ends = own + self.flat[:, 1], own + self.flat[:, 2]
        at = self.item[entry].astype(np.int64) * self.wide + self.place[entry]
        low = np.searchsorted(self._ends[1], at)
        return low, np.searchsorted(self._ends[0], at, "right") - low

    def bands(self, text: np.ndarray) -> tuple[list[tuple[int, int, int]], list[int], tuple[np.ndarray, np.ndarray]]:
        """(window, lowest and highest diagonal) of the bands that meet the bound; windows to be
        aligned with dense stretches; places and keys of the q-grams that are listed."""
        none = np.zeros(0, np.int64)
        if not len(self.key) or len(text) < Q:
            return [], [], (none, none)
        h = qgrams(text)
        at = np.flatnonzero(self.seen[(h >> X.U(64 - _BITS)).astype(np.int64)])
        k = np.searchsorted(self.key, h[at])
        k[k == len(self.key)] = 0
        hit = self.key[k] == h[at]
        at, k = at[hit], k[hit]
        if not len(at):
            return [], [], (none, none)
        bound = self.flat[:, 3].astype(np.int64)
        dense, use, all_at = none, np.ones(len(at), bool), (at, k)
        pairs = np.bincount(k, minlength=len(self.key)) * self.count
        if pairs.sum() > PAIRS:
            order = np.argsort(-pairs, kind="stable")
            out = order[: int(np.searchsorted(np.cumsum(pairs[order]), pairs.sum() - PAIRS)) + 1]
            missing = self._in_windows(out)
            over = np.flatnonzero(missing >= bound)
            if len({self._text(w) for w in over.tolist()}) <= DENSE:
                dense = over
                bound = bound - missing
                left_out = np.zeros(len(self.key), bool)
                left_out[out] = True
                use = ~left_out[k]
        at, k = at[use], k[use]
        n = self.count[k].astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        tally = [(none, none), (none, none)]
        wide = (len(text) + self.wide) // 2 + 2  # bands of a window, at most
        for t in range(0, total, AT_ONCE):
            pair = np.arange(t, min(t + AT_ONCE, total))
            p = np.searchsorted(ends, pair, "right")
            entry = self.first[k[p]] + (pair - (ends[p] - n[p]))
            diag = at[p] - self.place[entry] + self.wide
            low, many = self.windows(entry)
            stops = np.cumsum(many)
            w = np.repeat(low - (stops - many), many) + np.arange(stops[-1] if len(stops) else 0)
            diag = np.repeat(diag, many)
            width = 2 * (self.flat[w, 4].astype(np.int64) + 1)
            for half in (0, 1):
                keys, count = np.unique(w * wide + (diag + half * width // 2) // width, return_counts=True)
                old, held = tally[half]
                if len(old):
                    keys, inverse = np.unique(np.concatenate([old, keys]), return_inverse=True)
                    count = np.bincount(inverse, np.concatenate([held, count])).astype(np.int64)
                tally[half] = keys, count
        found = []
        for half, (keys, count) in enumerate(tally):
            w, band = keys // wide, keys % wide
            full = count >= bound[w]
            for wj, bj in zip(w[full].tolist(), band[full].tolist(), strict=True):
                width = 2 * (int(self.flat[wj, 4]) + 1)
                low = bj * width - half * width // 2 - self.wide
                found.append((wj, low, low + width - 1))
        apart = set(dense.tolist())
        return [x for x in sorted(set(found)) if x[0] not in apart], dense.tolist(), all_at

    def _in_windows(self, keys: np.ndarray) -> np.ndarray:
        """How many q-gram places of each window have one of keys."""
        out = np.zeros(len(self.flat) + 1, np.int64)
        for k in keys.tolist():
            for a in range(int(self.first[k]), int(self.first[k] + self.count[k]), AT_ONCE):
                low, many = self.windows(np.arange(a, min(a + AT_ONCE, int(self.first[k] + self.count[k]))))
                np.add.at(out, low, 1)
                np.add.at(out, low + many, -1)
        return np.cumsum(out)[:-1]

    def _text(self, w: int) -> bytes:
        i, s, last = self.flat[w, :3].tolist()
        return self.texts[i][s : last + Q]

    def stretches(self, start: int, end: int, w: int, at: np.ndarray) -> Iterator[tuple[int, int]]:
        """The parts of text[start:end] that are dense in the q-grams of window w, which stand at the
        places ``at``."""
        i, s, last, least, budget = self.flat[w].tolist()
        reach = last + Q - s + budget
        near = np.searchsorted(at, at + reach - Q, "right") - np.arange(len(at)) >= least  # a stretch that begins at a place
        at = at[near]
        if not len(at):
            return
        cut = np.flatnonzero(np.diff(at) > reach)
        for a, b in zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist(), strict=True):
            yield max(start, a - Q - budget), min(end, b + reach + Q)


def costs(patterns: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Row by row the edits of the cheapest alignment of a whole pattern that ends at each place of
    its region, from 0 on; a region is filled up with values that no byte has."""
    step = np.arange(regions.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(regions), regions.shape[1] + 1), np.int32)
    for i in range(patterns.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, :-1] + (regions != patterns[:, i : i + 1]), row[:, 1:] + 1, out=new[:, 1:])
        new -= step
        row = np.minimum.accumulate(new, axis=1)
        row += step
    return row


def _peaks(near: np.ndarray, budget: int) -> np.ndarray:
    """Places within the budget that no place up to ``budget`` away does better than."""
    low = near.copy()
    for s in range(1, min(budget, near.shape[1] - 1) + 1):
        np.minimum(low[:, s:], near[:, :-s], out=low[:, s:])
        np.minimum(low[:, :-s], near[:, s:], out=low[:, :-s])
    return (near <= budget) & (near == low)


def _together(parts: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(parts):
        if out and lo <= out[-1][1] + gap:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    return out


def _packed(text: np.ndarray, parts: list[tuple[int, int]], back: bool = False) -> np.ndarray:
    out = np.full((len(parts), max(e - s for s, e in parts)), 256, np.int16)
    for row, (s, e) in zip(out, parts, strict=True):
        row[: e - s] = text[s:e][::-1] if back else text[s:e]
    return out


def _groups(sizes: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Places of (pattern length, region length) in groups of one pattern length and few cells."""
    group: list[int] = []
    for n in sorted(range(len(sizes)), key=lambda x: sizes[x]):
        if group and (sizes[n][0] != sizes[group[0]][0] or sizes[n][1] * (len(group) + 1) > CELLS):
            yield group
            group = []
        group.append(n)
    if group:
        yield group


def alignments(text: np.ndarray, jobs: list[tuple[bytes, int, int, list[tuple[int, int]]]]) -> Iterator[tuple[int, int, int, int]]:
    """(job, start, end, edits) of all stretches within the budget of a pattern.  A job is a pattern,
    the range of its document, and regions of it that hold every such stretch.

    Of all places where an alignment within the budget ends, those count that none near by does
    better than; places of equal edits whose stretches overlap are one stretch.  That follows
    from the pattern and the document alone, whatever the regions are besides."""
    tasks = []
    for n, (pattern, start, end, regions) in enumerate(jobs):
        budget = len(pattern) // RATE
        tasks += [(n, lo, hi) for lo, hi in _together([(max(lo, start), min(hi, end)) for lo, hi in regions], 2 * budget) if hi - lo >= len(pattern) - budget]
    runs = []  # job, first and last end, edits

    def collect(n: int, lo: int, near: np.ndarray, peak: np.ndarray) -> None:
        at = np.flatnonzero(peak)
        if len(at):
            size, edits = len(jobs[n][0]), near[at]
            new = np.append(True, (np.diff(at) > size - size // RATE) | (np.diff(edits) != 0))
            first = np.flatnonzero(new)
            runs.extend((n, lo + int(a), lo + int(b), int(c)) for a, b, c in zip(at[first], at[np.append(first[1:], len(at)) - 1], edits[first], strict=True))

    for group in _groups([(len(jobs[n][0]), hi - lo) for n, lo, hi in tasks]):
        size = len(jobs[tasks[group[0]][0]][0])
        budget = size // RATE
        patterns = np.stack([np.frombuffer(jobs[tasks[g][0]][0], np.uint8) for g in group])
        parts = [tasks[g][1:] for g in group]
        if parts[-1][1] - parts[-1][0] > CELLS:  # one long region, in overlapping pieces
            (lo, hi), reach = parts[0], size + budget
            near = np.full((1, hi - lo + 1), budget + 1, np.int32)
            for a in range(lo, hi, CELLS):
                s, e = max(lo, a - reach), min(a + CELLS, hi)
                near[0, a - lo + 1 : e - lo + 1] = costs(patterns, text[None, s:e])[0, a - s + 1 :]
            near = np.minimum(near, budget + 1)
        else:
            near = np.minimum(costs(patterns, _packed(text, parts)), budget + 1)
            near[np.arange(near.shape[1]) > np.array([e - s for s, e in parts])[:, None]] = budget + 1
        near[:, 0] = budget + 1
        for g, c, peak in zip(group, near, _peaks(near, budget), strict=True):
            collect(tasks[g][0], tasks[g][1], c, peak)
    behind = [(max(jobs[n][1], first - len(jobs[n][0]) - len(jobs[n][0]) // RATE), first) for n, first, _, _ in runs]
    for group in _groups([(len(jobs[runs[r][0]][0]), behind[r][1] - behind[r][0]) for r in range(len(runs))]):
        patterns = np.stack([np.frombuffer(jobs[runs[r][0]][0], np.uint8)[::-1] for r in group])
        parts = [behind[r] for r in group]
        back = costs(patterns, _packed(text, parts, back=True))
        back[np.arange(back.shape[1]) > np.array([e - s for s, e in parts])[:, None]] = 1 << 20
        for r, steps in zip(group, back.argmin(1).tolist(), strict=True):
            n, first, last, edits = runs[r]
            yield n, first - steps, last, edits


def _as_it_stands(text: bytes, pattern: bytes, start: int, end: int, regions: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Where pattern stands in the regions of text[start:end], not within a word."""
    for lo, hi in _together([(max(lo, start), min(hi, end)) for lo, hi in regions], 0):
        at = text.find(pattern, lo, hi)
        while at >= 0:
            to = at + len(pattern)
            if not ((at > start and _word(text[at - 1]) and _word(text[at])) or (to < end and _word(text[to]) and _word(text[to - 1]))):
                yield at, to
            at = text.find(pattern, at + 1, hi)


def ends_of(pattern: bytes, region: bytes) -> np.ndarray:
    """The edits of the cheapest alignment of the whole pattern that ends at each place."""
    return costs(np.frombuffer(pattern, np.uint8)[None], np.frombuffer(region, np.uint8)[None])[0]


def _whole_lines(ix: Index, text: bytes, own: np.ndarray, raw: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, start, end) of lines, in the original, that are an item shorter than a q-gram."""
    line_ends = np.flatnonzero(raw == 10)
    for d, (a, b) in enumerate(zip(own[:-1].tolist(), own[1:].tolist(), strict=True)):
        if a == b:
            continue
        breaks = np.searchsorted(place, line_ends[(line_ends >= place[a]) & (line_ends <= place[b - 1])])
        for s, e in zip([a, *breaks.tolist()], [*breaks.tolist(), b], strict=True):
            line = text[s:e]
            got = line.strip(b" ")
            if got in ix.lines:
                s += len(line) - len(line.lstrip(b" "))
                for item in ix.lines[got]:
                    yield d, item, s, s + len(got)


def spans_of(ix: Index, part: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, start, end, edits) in bytes of the original, by document and item, spans that
    overlap or touch as one."""
    text, own, place = collapsed(normal(part), offsets)
    whole = text.tobytes()
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    close, dense, (at, k) = ix.bands(text)
    near: dict[tuple[int, bytes], tuple[list[tuple[int, int]], set[int]]] = {}  # by document and pattern: regions, items

    def propose(d: int, windows: list[int], regions) -> None:
        held = near.setdefault((d, ix._text(windows[0])), ([], set()))
        held[0].extend(regions)
        held[1].update(ix.flat[windows, 0].tolist())

    for w, low, high in close:
        _, s, last, _, budget = ix.flat[w].tolist()
        first = int(np.searchsorted(own, max(low + s - budget, 0), "right")) - 1
        for d in range(max(first, 0), len(own) - 1):  # a band may reach over the end of a document
            if own[d] >= high + last + Q + budget:
                break
            propose(d, [w], [(low + s - budget, high + last + Q + budget)])
    shapes: dict[bytes, list[int]] = {}
    for w in dense:
        shapes.setdefault(ix._text(w), []).append(w)
    for pattern, same in shapes.items():
        keys = np.searchsorted(ix.key, np.unique(qgrams(np.frombuffer(pattern, np.uint8))))
        mine = at[np.isin(k, keys)]
        doc = np.searchsorted(own, mine, "right") - 1
        inside = mine + Q <= own[doc + 1]
        mine, doc = mine[inside], doc[inside]
        cut = np.flatnonzero(np.diff(doc)) + 1
        for d, places in zip(doc[np.append(0, cut)].tolist() if len(doc) else (), np.split(mine, cut), strict=False):
            propose(d, same, ix.stretches(int(own[d]), int(own[d + 1]), same[0], places))
    jobs, items = [], []
    for (d, pattern), (regions, of) in near.items():
        start, end = int(own[d]), int(own[d + 1])
        if len(pattern) < EXACT:
            for a, b in _as_it_stands(whole, pattern, start, end, regions):
                for item in of:
                    found.setdefault((d, item), []).append((a, b, 0))
        else:
            jobs.append((pattern, start, end, regions))
            items.append((d, of))
    for n, a, b, edits in alignments(text, jobs):
        d, of = items[n]
        for item in of:
            found.setdefault((d, item), []).append((a, b, edits))
    if ix.lines:
        for d, item, s, e in _whole_lines(ix, whole, own, part, place):
            found.setdefault((d, item), []).append((s, e, 0))
    for (d, item), spans in sorted(found.items()):
        merged: list[list[int]] = []
        for s, e, cost in sorted(set(spans)):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
                merged[-1][2] = max(merged[-1][2], cost)
            else:
                merged.append([s, e, cost])
        for s, e, cost in merged:
            yield d, item, int(place[s]), int(place[e - 1]) + 1, cost


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for batch in batches:
            offsets, raw = X.buffers(batch.column(1))
            ids = batch.column(0)
            for i, j in X.slices(offsets):
                part, own = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                rows = []
                for d, item, s, e, cost in spans_of(ix, part, own):
                    points = X.codepoints(part[own[d] : e])
                    rows.append((i + d, int(ix.ids[item]), int(points[: s - own[d]].sum()), int(points.sum()), cost))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "item_id", "start", "end", "edits"])

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    ids, texts, held = [], [], 0
    rows = benchmark.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    for item, text in rows.toLocalIterator():
        raw = text.encode("utf-8", "replace")
        ids.append(item)
        texts.append(raw)
        held += len(raw)
        if held >= BLOCK_BYTES:
            yield Index(ids, texts)
            ids, texts, held = [], [], 0
    if ids or held == 0:
        yield Index(ids, texts)


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per stretch of a document that repeats a stretch of a benchmark item:
    ``doc_id, item_id, start, end, edits``; places in code points, end exclusive, ``edits``
    the most of any window of the stretch.  Clean documents have no row.

    A stretch counts from a window of ``WINDOW`` bytes (the whole item if that is shorter) with
    an edit for every ``RATE`` bytes at most; windows begin every ``STRIDE`` bytes, so any
    ``WINDOW + STRIDE - 1`` bytes of an item hold one.  Items under ``EXACT`` bytes count where they
    stand as they are and not within a word; those under ``Q`` bytes where they are a line of
    the document.  Null, empty or blank texts and items give nothing; a null item id isn't
    searched; items with equal texts are found each; a null doc_id stays null; repeated rows get
    equal results; other columns aren't read; an empty table gives no rows.

    A benchmark of several blocks is searched block by block, each search written before the
    next block is gathered.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, start long, end long, edits long"
    ws = Workspace(spark, "leaks")
    parts, blocks = [], _blocks(benchmark, item_col, item_text_col)
    index = next(blocks)
    while True:
        held = spark.sparkContext.broadcast(index)
        found = rows.transform(mapped(_search(held), schema))
        index = next(blocks, None)
        if index is None:
            return reduce(DataFrame.union, parts, found)
        parts.append(ws.save(found, "found"))
        held.destroy()
