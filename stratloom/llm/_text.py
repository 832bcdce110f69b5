"""Vectorised work on Arrow text columns: words, word hashes and hash mixing.

A word is a run of bytes other than the six ASCII white-space bytes (space, \\t, \\n,
\\v, \\f, \\r); A-Z count as a-z.  Work goes in blocks of a few MB, cut at white space,
so that memory doesn't follow the size of a batch or of one document.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 2 << 20
U = np.uint64
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = col.chunk(0) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    n = len(col)
    if off is None or n == 0:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return offsets - offsets[0], raw


def slices(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of documents [i, j) of about ``most`` bytes each, one document at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


@functools.cache
def _tables() -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(20240229)
    r = int(rng.integers(1 << 62, 1 << 63)) | 1
    return rng.integers(1, 1 << 63, 256, dtype=U), r, pow(r, -1, 1 << 64)


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("r", ())) < n:
        _, r, inverse = _tables()
        n = max(n, BLOCK + 1)
        for key, base in (("r", r), ("i", inverse)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["r"], _powers["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    h = h ^ (h >> U(31))
    h = h * U(0x9E3779B97F4A7C15)
    h = h ^ (h >> U(29))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def _block_words(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of raw; a word ends at each of breaks too."""
    inside = ~IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[breaks] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def words(raw: np.ndarray, offsets: np.ndarray, hashed: bool = True, lower: bool = True, also=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of (lower-cased) documents; ``also`` gives
    further places in a block at which words end."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U)
    parts, at, size = [], 0, len(raw)
    while at < size:
        to = min(at + BLOCK, size)
        if to < size:  # the cut falls on white space or between documents
            gaps = np.flatnonzero(IS_SPACE[raw[at:to]])
            doc = offsets[np.searchsorted(offsets, to, "right") - 1]
            cut = max(int(at + gaps[-1] + 1) if len(gaps) else at, int(doc))
            if cut <= at:  # one word fills the block
                step = to
                while step < size and not IS_SPACE[raw[step : step + BLOCK]].any():
                    step += BLOCK
                gaps = np.flatnonzero(IS_SPACE[raw[step : step + BLOCK]]) if step < size else ()
                cut = int(step + gaps[0] + 1) if len(gaps) else size
                later = offsets[np.searchsorted(offsets, at, "right") :]
                cut = min(cut, int(later[0])) if len(later) and later[0] > at else cut
            to = cut
        part = LOWER[raw[at:to]] if lower else raw[at:to]
        lo, hi = np.searchsorted(offsets, [at, to])
        inner = offsets[lo:hi] - at
        s, e = _block_words(part, inner if also is None else np.concatenate([inner, also(part)]))
        h = np.zeros(len(s), U)
        if hashed and len(s):
            table, _, _ = _tables()
            power, inverse = _power(len(part) + 1)
            total = np.empty(len(part) + 1, U)
            total[0] = 0
            np.cumsum(table[part] * power[: len(part)], out=total[1:])
            h = mix((total[e] - total[s]) * inverse[s])
        parts.append((s + at, e + at, h))
        at = to
    if len(parts) == 1:
        return parts[0]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def word_bounds(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each document the index of its first word, and the count of words at the end."""
    return np.searchsorted(starts, offsets)


def codepoints(raw: np.ndarray) -> np.ndarray:
    """Where code points begin: bytes that don't continue one."""
    return (raw & 0xC0) != 0x80


def unsigned_crc(texts) -> np.ndarray:
    import zlib

    return np.array([zlib.crc32(t) for t in texts], np.int64)


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over [offsets[i], offsets[i + 1])."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
