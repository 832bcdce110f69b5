"""Personal data: high-recall generators, boosted trees on each candidate, calibrated thresholds.

The base rules find e-mail addresses, IPv4 addresses, card numbers and telephone numbers
in one linear pass each and always count.  Wider generators propose what those rules miss:
telephone numbers without a plus sign, addresses spelt with "at" and "dot", cards with
other separators, IBANs and social security numbers.  A candidate's format and the words
before it go through gradient-boosted trees; it becomes a span if its calibrated
probability reaches the threshold of its kind and it overlaps no span that stands already.

The trees are fitted once on the driver from ``TRAINING`` candidates of a seeded generator
that writes true and false cases into words, false ones in the format of true ones among them,
which only the words around tell apart; a third part calibrates them and sets each
threshold as the lowest one, from 0.5 on, with a precision of 0.99 there.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._boost import Trees
from ._store import mapped
from ._spans import digest, joined

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
TRAINING = 6000
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each
    at sign outwards, so that long runs without one cost nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        end = at + 1
        if s < at and (m := _DOMAIN.match(text, at + 1)):
            end = last = m.end()
            yield s, end
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = _digits(m[0])
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return out


#: Generators of candidates, by kind; each runs on a window of a bounded pattern.
GENERATORS = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,40}(?:\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?|\x20(?:at|AT)\x20)[A-Za-z0-9-]{2,40}(?:(?:\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)[A-Za-z]{2,12}){1,3}")),
    ("card", re.compile(r"(?<![0-9A-Za-z.])[0-9]{4}([._/]|\x20{2,3}|\x20?-\x20?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+.])(?:\(0?[0-9]{2,4}\)\x20?|00[1-9][0-9]{0,2}[\x20.-]|0[0-9]{2,4}[\x20./-]|[2-9][0-9]{2}[\x20.-])[0-9]{3,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9A-Za-z])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    ("ssn", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}(?![0-9A-Za-z-])")),
)
_CUES = {
    "email": ("mail", "contact", "write", "reach"),
    "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "whatsapp"),
    "iban": ("iban", "account", "bank", "konto"),
    "ssn": ("ssn", "social", "security"),
}
_AGAINST = ("version", "isbn", "order", "page", "date", "id", "no.", "figure", "serial", "part", "invoice")


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(kind: str, text: str, s: int, e: int) -> list[float]:
    span = text[s:e]
    before, after = text[max(0, s - 32) : s].lower(), text[e : e + 16].lower()
    d = _digits(span)
    groups = re.findall(r"[0-9]+", span)
    words = re.split(r"[^a-z.]+", before)
    return [
        float(KINDS.index(kind)),
        float(len(span)),
        float(len(d)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(luhn(d)) if 12 <= len(d) <= 19 else -1.0,
        float(kind == "iban" and iban_ok(span)),
        float(len(set(d))),
        float(span.count(" ")),
        float(span.count("-")),
        float(span.count(".")),
        float(span.count("(")),
        float("[" in span or "{" in span or "(" in span),
        float(span.rsplit(".", 1)[-1].lower() in ("com", "org", "net", "edu", "gov", "info", "io")) + float(re.search(r"(?:com|org|net|edu|gov|info|io|de|fr|es|uk)$", span.lower()) is not None),
        float(any(c in before for c in _CUES[kind])),
        float(any(w in _AGAINST for w in words[-4:])),
        float(before[-2:-1] in (":", "=", "#")),
        float(after[:1] in (" ", "", ",", ".", "\n", ")")),
        float(kind == "ssn" and d[:3] not in ("000", "666") and d[:1] != "9" and d[3:5] != "00" and d[5:] != "0000"),
        float(d[:1] in ("3", "4", "5", "6")),
    ]


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    digit = _DIGIT.search(text) is not None
    low = None
    for kind, pattern in GENERATORS:
        if kind == "email":
            low = text.lower()
            if not ("dot" in low or "[at]" in low or "(at)" in low or " at " in low):
                continue
            if not re.search(r"[\[({]\x20?at\x20?[\])}]|\x20at\x20[a-z0-9-]{2,40}\x20dot\x20", low):
                continue
        elif not digit:
            return
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def _cases(n: int) -> Iterator[tuple[str, str, int, int, int]]:
    """(kind, text, start, end, label) from a seeded generator."""
    rng = np.random.default_rng(31)
    fill = ["the", "of", "and", "on", "was", "here", "there", "report", "les", "und", "por", "with", "under", "given"]

    def num(k: int) -> str:
        return "".join(map(str, rng.integers(0, 10, k)))

    def name() -> str:
        return "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(3, 9))))

    def card(good: bool) -> str:
        d = str(rng.choice([3, 4, 5, 6])) + num(14)
        last = next(c for c in "0123456789" if luhn(d + c))
        d += last if good else str((int(last) + int(rng.integers(1, 10))) % 10)
        sep = str(rng.choice([".", "_", "/", "  ", " - "]))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    for _ in range(n):
        kind = str(rng.choice(list(_CUES)))
        good = bool(rng.random() < 0.5)
        alike = not good and bool(rng.random() < 0.3)  # in the format of a true one
        cue = bool(rng.random() < (0.6 if good else 0.0 if alike else 0.03))
        if kind == "email":
            box = bool(rng.random() < 0.5)
            at, dot = (" [at] ", " [dot] ") if box else (" at ", " dot ")
            span = f"{name()}{at}{name()}{dot if good or box else '.'}{str(rng.choice(['com', 'org', 'net'])) if good else name()}"
        elif kind == "card":
            span = card(good)
        elif kind == "phone":
            span = str(rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"00{rng.integers(1, 99)} {num(3)} {num(3)} {num(3)}", f"{rng.integers(200, 999)}-{num(3)}-{num(4)}"])) if good or alike else str(rng.choice([f"{rng.integers(200, 999)} {num(3)} {num(3)}", f"{rng.integers(200, 999)}.{num(3)}.{num(3)}", f"0{num(2)}.{num(3)}.{num(2)}", f"{rng.integers(200, 999)} {num(4)} {num(4)} {num(4)}"]))
        elif kind == "iban":
            c, body = str(rng.choice(["DE", "FR", "ES", "GB"])), num(18)
            check = next(k for k in range(2, 99) if iban_ok(f"{c}{k:02d}{body}"))
            k = check if good else (check + int(rng.integers(1, 90))) % 97 + 2
            s = f"{c}{k:02d}{body}"
            good = iban_ok(s)
            span = " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rng.random() < 0.5 else s
        else:
            span = f"{rng.integers(1, 665):03d}-{rng.integers(1, 99):02d}-{rng.integers(1, 9999):04d}" if good or alike else str(rng.choice([f"000-{num(2)}-{num(4)}", f"9{num(2)}-{num(2)}-{num(4)}", f"{num(3)}-00-{num(4)}", f"{num(3)} {num(2)} {num(4)}"]))
        lead = [str(rng.choice(_CUES[kind]))] if cue else ([str(rng.choice(_AGAINST))] if not good and rng.random() < (0.9 if alike else 0.4) else [])
        prefix = " ".join([str(w) for w in rng.choice(fill, 3)] + lead) + (": " if cue and rng.random() < 0.5 else " ")
        text = f"{prefix}{span} " + " ".join(rng.choice(fill, 2))
        yield kind, text, len(prefix), len(prefix) + len(span), int(good)


@functools.cache
def model() -> tuple[Trees, dict[str, float]]:
    rows, labels, kinds = [], [], []
    for kind, text, s, e, y in _cases(TRAINING):
        rows.append(features(kind, text, s, e))
        labels.append(y)
        kinds.append(kind)
    x, y, kinds = np.array(rows), np.array(labels, float), np.array(kinds)
    part = np.arange(len(y)) % 3 == 2
    trees = Trees(rounds=80, depth=4).fit(x[~part], y[~part]).calibrate(x[part], y[part])
    p = trees.predict(x[part])
    cuts = {}
    for kind in _CUES:
        mine = kinds[part] == kind
        q, t = p[mine], y[part][mine]
        order = np.argsort(-q)
        precise = np.cumsum(t[order]) / np.arange(1, len(t) + 1)
        ok = np.flatnonzero(precise >= 0.99)
        cuts[kind] = max(0.5, float(q[order][ok[-1]])) if len(ok) else 2.0
    return trees, cuts


def added_spans(text: str, base, trees: Trees, cuts: dict[str, float]) -> list[tuple[str, int, int]]:
    """Accepted candidates, the likeliest first, that overlap nothing accepted before."""
    found = list(dict.fromkeys(candidates(text)))
    if not found:
        return []
    p = trees.predict(np.array([features(k, text, s, e) for k, s, e in found]))
    taken = [(s, e) for _, s, e in base]
    out = []
    for i in np.lexsort((np.arange(len(p)), -p)).tolist():
        kind, s, e = found[i]
        if p[i] >= cuts[kind] and not any(s < b and a < e for a, b in taken):
            taken.append((s, e))
            out.append((kind, s, e))
    return out


def scan(text: str | None, trees: Trees, cuts: dict[str, float]) -> tuple[list, list]:
    if not text:
        return [], []
    base = base_spans(text)
    return base, base + added_spans(text, base, trees, cuts)


def personal_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    The counts and the digest are of the base rules; ``spans`` adds accepted candidates.
    A null or empty text has none; a null id stays null; repeated rows get equal results;
    other columns aren't read; no rows give none.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, cuts = fitted.value
        for batch in batches:
            out = []
            for value in batch.column(1):
                base, spans = scan(value.as_py(), trees, cuts)
                out.append((*(sum(k == kind for k, _, _ in base) for kind in KINDS[:4]), digest(base, KINDS), joined(spans, KINDS)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.transform(mapped(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"))


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The input with each span replaced by its kind in brackets.

    Of spans that overlap the one that begins first, then the longest, gives its kind, and all that they
    cover is replaced; a null or empty text stays as it is; repeated rows get equal results;
    all other columns stay; no rows give none.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(model())

    def clean(text: str | None) -> str | None:
        _, spans = scan(text, *fitted.value)
        out, last = [], 0
        for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
            if s >= last:
                out += [text[last:s], f"[{kind.upper()}]"]
                last = e
            elif e > last:  # overlaps the one before
                last = e
        return "".join([*out, text[last:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            new = pa.array([clean(v.as_py()) for v in batch.column(at)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at).name, new)

    return docs.transform(mapped(run, docs.schema))
