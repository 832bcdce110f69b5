"""Helpers for span results: ordering, digests and code-point offsets."""

from __future__ import annotations

import hashlib


def joined(spans, kinds: tuple[str, ...]) -> str:
    """kind:start:end of the spans, by start, then kind as listed, then end."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2])))


def digest(spans, kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()
