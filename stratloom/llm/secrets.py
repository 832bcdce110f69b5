"""Secret scans over a worklist of decoded layers.

The text is scanned as it stands.  Then each stretch that carries an encoding becomes a
layer: percent escapes, backslash-u and backslash-x escapes and character references are
undone over a whole line, base64 and gzip / zlib / zstandard data over a whole token.  A
layer is scanned and searched for further layers in turn, until nothing new turns up.
Every character of a layer knows the range of the original text that it came from, so a
find deep down is a span of the original.  A layer text that was met before at the same
place is not entered again (cycles).  A layer need not be text: what isn't UTF-8 is read byte
by byte, and what holds NULs also without them (UTF-16).  Compressed data is unpacked in pieces of
``MOST`` bytes, cut only where no find, escape or token can go on (a token of more than
``LONGEST`` bytes is cut all the same).  Base64 wrapped over lines is joined first; a token that
doesn't decode to text as it stands is also read from its next three characters, and
between its dashes and underscores, since something may be glued to its front.

The worklist holds what is still to be decoded, not the layers, and a layer's places are arrays
(of no size where all of it came from one token), so memory follows the depth of the nesting.
"""

from __future__ import annotations

import base64
import binascii
import html
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import mapped
from ._spans import digest, joined

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of 24 or more are what [0-9a-f]+ leaves of that length
_WORDS = ("passw", "secret", "token", "api")
_HINT = re.compile(r"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#?[0-9A-Za-z]+;")
_B64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[ \t]*+\r?\n[ \t]*+)++(?:(?!-----)[A-Za-z0-9+/_-]+={0,2})?")
_ESCAPES = re.compile(r"((?:%[0-9A-Fa-f]{2})+)|((?:\\u[0-9A-Fa-f]{4})+)|((?:\\x[0-9A-Fa-f]{2})+)|(&#?[0-9A-Za-z]+;)")
_SUB = re.compile(r"[A-Za-z0-9+/]{16,}")
MOST = 1 << 22
LONGEST = 1 << 26
#: Bytes of which finds, escapes and tokens are made.
_INSIDE = np.zeros(256, bool)
_INSIDE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-:\"'%\\&#; \t\r\n\0")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True
_MAGIC = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda", b"\x28\xb5\x2f\xfd")


def base_spans(text: str, low: str | None = None) -> list[tuple[str, int, int]]:
    """The finds of the three patterns, each leftmost and non-overlapping."""
    out = []
    low = text.lower() if low is None else low
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


class Layer:
    """A decoded text; character i came from [at[i], to[i]) of the original, and fresh[i]
    tells whether it was decoded."""

    __slots__ = ("at", "fresh", "text", "to")

    def __init__(self, text: str, at: np.ndarray, to: np.ndarray, fresh: np.ndarray):
        self.text, self.at, self.to, self.fresh = text, at, to, fresh


def _same(value: int, n: int) -> np.ndarray:
    return np.broadcast_to(np.int64(value), n)


def _plain(text: str, start: int) -> Layer:
    at = np.arange(start, start + len(text))
    return Layer(text, at, at + 1, _same(0, len(text)))


def _unescape(x: Layer) -> Layer | None:
    """Undoes one round of character escapes."""
    parts, at, to, fresh, last = [], [], [], [], 0

    def keep(a: int, b: int) -> None:
        parts.append(x.text[a:b])
        at.append(x.at[a:b])
        to.append(x.to[a:b])
        fresh.append(x.fresh[a:b])

    for m in _ESCAPES.finditer(x.text):
        run = m[0]
        if m[1] or m[3]:
            raw = unquote_to_bytes(run) if m[1] else bytes.fromhex(run.replace("\\x", ""))
            step = len(run) // len(raw)
            try:
                new = raw.decode("utf-8")
                width = [len(c.encode()) * step for c in new]
            except UnicodeDecodeError:
                new, width = raw.decode("latin-1"), [step] * len(raw)
        elif m[2]:
            new = run.encode("ascii").decode("unicode_escape").encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            width = [12 if ord(c) > 0xFFFF else 6 for c in new]
            if sum(width) != len(run):
                continue
        else:
            new = html.unescape(run)
            if new == run:
                continue
            width = [len(run)] + [0] * (len(new) - 1)
        keep(last, m.start())
        w = np.array(width, np.int64)
        p = m.start() + np.cumsum(w) - w
        parts.append(new)
        at.append(x.at[np.where(w > 0, p, m.start())])
        to.append(x.to[np.where(w > 0, p + w - 1, m.end() - 1)])
        fresh.append(_same(1, len(new)))
        last = m.end()
    if not last:
        return None
    keep(last, len(x.text))
    return Layer("".join(parts), np.concatenate(at), np.concatenate(to), np.concatenate(fresh))


def _views(raw: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Texts that the bytes can be read as, with the first byte of each character and the one
    after its last."""
    b = np.frombuffer(raw, np.uint8)
    try:
        text = raw.decode("utf-8")
        first = np.flatnonzero((b & 0xC0) != 0x80)
    except UnicodeDecodeError:
        text, first = raw.decode("latin-1"), np.arange(len(raw))
    after = np.append(first[1:], len(raw))
    if text:
        yield text, first, after
    if "\0" in text:
        kept = b[first] != 0
        yield text.replace("\0", ""), first[kept], after[kept]


def _unpacked(raw: bytes) -> Iterator[bytes]:
    """The data of all members of a compressed stream, MOST bytes at most at a time."""
    try:
        if raw[:4] == _MAGIC[-1]:
            import zstandard

            with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as r:
                while piece := r.read(MOST):
                    yield piece
            return
        while raw[:2] in _MAGIC:
            d = zlib.decompressobj(47)
            piece = d.decompress(raw, MOST)
            while piece:
                yield piece
                piece = d.decompress(d.unconsumed_tail, MOST)
            raw = d.unused_data
    except Exception:  # noqa: BLE001  what isn't such data ends here
        return


def _last_break(piece: bytes) -> int:
    """The last place at which nothing that is looked for can go on: after an ASCII character
    that is part of none of it, or after white space that follows such or a character beyond ASCII."""
    b = np.frombuffer(piece, np.uint8)
    ends = ~_INSIDE[b] & (b < 128)
    ends[1:] |= _BLANK[b[1:]] & ~_INSIDE[b[:-1]]
    found = np.flatnonzero(ends)
    return int(found[-1]) + 1 if len(found) else 0


def _inflate(raw: bytes) -> Iterator[bytes]:
    """Compressed data in pieces that nothing reaches across."""
    held: list[bytes] = []
    size = 0
    for piece in _unpacked(raw):
        held.append(piece)
        size += len(piece)
        if size < MOST:
            continue
        cut = _last_break(piece) or (len(piece) if size >= LONGEST else 0)
        if cut:
            yield b"".join([*held[:-1], piece[:cut]])
            held, size = [piece[cut:]], len(piece) - cut
    if size:
        yield b"".join(held)


def _wrapped(x: Layer) -> Iterator[Layer]:
    """Base64 over several lines, joined."""
    for m in _WRAPPED.finditer(x.text):
        at = m.start() + np.flatnonzero([not c.isspace() for c in m[0]])
        yield Layer("".join(m[0].split()), x.at[at], x.to[at], x.fresh[at])


def _decoded(x: Layer, s: int, e: int) -> Iterator[tuple[bool, Iterator[Layer]]]:
    """Readings of the token [s, e) of x from each of its first four characters: whether it is
    surely one, and its layers."""
    run = x.text[s:e].rstrip("=").replace("-", "+").replace("_", "/")
    for shift in range(min(4, len(run) - 15)):
        body = run[shift:]
        body = body[: len(body) - (len(body) % 4 == 1)]
        try:
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
        except (binascii.Error, ValueError):
            continue
        if raw[:2] in _MAGIC or raw[:4] in _MAGIC:
            first = next(pieces := _inflate(raw), None)
            if first is not None:
                yield True, (Layer(t, _same(x.at[s], len(t)), _same(x.to[e - 1], len(t)), _same(1, len(t))) for piece in _chain(first, pieces) for t, _, _ in _views(piece))
                return
        sure = raw.isascii() and raw.translate(None, _TEXT) == b""
        yield sure, _mapped(x, s + shift, e, raw)
        if sure:
            return


_TEXT = bytes([9, 10, 13, *range(32, 127)])


def _chain(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def _mapped(x: Layer, s: int, e: int, raw: bytes) -> Iterator[Layer]:
    for text, first, after in _views(raw):
        yield Layer(text, x.at[s + first * 8 // 6], x.to[np.minimum(s + (after * 8 + 5) // 6, e) - 1], _same(1, len(text)))


def _base64(x: Layer) -> Iterator[Layer]:
    """Layers of the base64 tokens, unpacked where they hold compressed data."""
    for m in _B64.finditer(x.text):
        s, e = m.span()
        known = False
        for sure, found in _decoded(x, s, e):
            known |= sure
            yield from found
        if not known and ("-" in m[0] or "_" in m[0]):
            for part in _SUB.finditer(x.text, s, e):
                for _, found in _decoded(x, part.start(), part.end()):
                    yield from found


def _first_layers(text: str) -> Iterator[Layer]:
    if _HINT.search(text):
        start = 0
        for line in text.split("\n"):
            if _HINT.search(line) and (y := _unescape(_plain(line, start))):
                yield y
            start += len(line) + 1
    for m in _B64.finditer(text):
        yield from _base64(_plain(m[0], m.start()))
    for m in _WRAPPED.finditer(text):
        for y in _wrapped(_plain(m[0], m.start())):
            yield from _base64(y)


def _next_layers(x: Layer) -> Iterator[Layer]:
    if (y := _unescape(x)) is not None:
        yield y
    yield from _base64(x)
    for y in _wrapped(x):
        yield from _base64(y)


def decoded_spans(text: str) -> set[tuple[str, int, int]]:
    """Finds in decoded layers, as ranges of the original text."""
    found: set[tuple[str, int, int]] = set()
    seen: set[tuple[bytes, int, int]] = set()
    work = [_first_layers(text)]
    while work:
        x = next(work[-1], None)
        if x is None:
            work.pop()
            continue
        key = (blake2b(x.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), int(x.at[0]), int(x.to[-1])) if x.text else None
        if key is None or key in seen:
            continue
        seen.add(key)
        for kind, s, e in base_spans(x.text):
            if x.fresh[s:e].any():
                found.add((kind, int(x.at[s:e].min()), int(x.to[s:e].max())))
        work.append(_next_layers(x))
    return found


def scan(text: str | None) -> tuple[list, list]:
    """Base spans, and all spans."""
    if not text:
        return [], []
    base = base_spans(text)
    more = decoded_spans(text) - set(base) if _HINT.search(text) or _B64.search(text) else set()
    return base, base + sorted(more)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for value in batch.column(1):
            base, spans = scan(value.as_py())
            n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            out.append((*n, digest(base, KINDS), joined(spans, KINDS)))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    The counts and the digest are of the finds in the text itself; ``spans`` adds those in
    decoded layers.  A null or empty text has none; a null id stays null; repeated rows get
    equal results; other columns aren't read; no rows give none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.transform(mapped(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"))


def redacted(text: str | None, spans, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones as one, replaced by mark."""
    if not spans:
        return text
    out, last = [], 0
    merged: list[list[int]] = []
    for _, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[last:s], mark]
        last = e
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The input with secrets replaced in ``text_col``; all other columns as they are.

    Spans that overlap become one mark, spans that touch one each; a null or empty text stays as it is;
    repeated rows get equal results; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            new = pa.array([redacted(t, scan(t)[1], mark) for t in (v.as_py() for v in batch.column(at))], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at).name, new)

    return docs.transform(mapped(run, docs.schema))
