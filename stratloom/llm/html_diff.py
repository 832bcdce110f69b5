"""Main text of web pages by structure and by nearest-URL page differencing.

A page is cut into text lines (blocks) in one pass over its tags.  A line stands in a frame element
(navigation, forms, asides, ..., by name or by the words of class, id or role), in the
article that the page marks, in its main part (``main``, which may hold more than the article), or in
none; on a page that marks either all other lines count as frame.  Within these only frame tags, hidden
elements and whole names of adverts, comments and the like take anything out.

Every page is differenced, over all of its lines, and its text is what that leaves.  Pages are ordered by
host and URL path with one range exchange.  The page
with the longest path in common with another one stands next to it in that order, so each page
is paired with its ``NEAR`` neighbours of the same host on either side.  All of its lines are aligned
by longest common subsequence with those of theirs that stand in no article or main part, and
aligned lines are deleted: they belong to the frame of the site.
Pages of one host also carry copies of one article.  So where a page has several neighbours, a line
goes if it is aligned with two of them, or with one and the page isn't a copy of that one (most of
its other lines aren't aligned), or with one that marks its article; a neighbour that leaves nothing of the page tells
nothing.  Lines of a main part are aligned with those of the neighbours' and go if all of these share them, two at
least, unless that is most of the part.  Structure follows as a check: aligned lines of a marked article stay, as passages and licence
lines recur on neighbours too, and what differencing leaves in frame elements goes (menus and adverts
differ from page to page).  Only 61 bits of
a line's hash and its standing travel between pages, and each page is parsed once.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Workspace, mapped

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*+)(?:>|\Z)|</?\Z|</[^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW = {t: re.compile(rf"</{t}(?:[\s/][^>]*)?(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_SKIP = frozenset("nav header footer aside form script style noscript template iframe svg canvas select button textarea title head menu dialog object math audio video figcaption datalist".split())
#: Words of class, id or role that name something other than main text.
_FRAME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment comments disqus replies reply respond pagination pager toolbar complementary contentinfo".split()
)
_STEM = re.compile("comment(s|list|form|area|box|section|thread)|advert|sidebar|newsletter|cookie|breadcrumb|sponsor|popup|disqus|masthead|pagination|navbar")
#: Whole names of class, id or role that a marked article gives to what isn't its text.
_INNER = frozenset("ad ads advert adverts advertisement advertisements adsbygoogle sponsored comment comments disqus disqus_thread respond sidebar newsletter complementary navigation banner contentinfo".split())
#: Elements of text, which a marked article loses by no name.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figure table ul ol dl".split())
#: Words before a frame word that speak of the layout around it, as in no-sidebar.
_LAYOUT = frozenset("no has with without hide show".split())
#: Elements that the next one of their kind, or the end of what holds them, closes.
_IMPLIED = {"p": None, "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",)}
_ROOTS = frozenset(("article", "main"))
FRAME, OPEN, MARKED, MAIN = range(4)
NEAR = 2
RUN = 1024  # pages in a row that a task pairs at once
MATCHES = 1 << 20


def _framed(attrs: str, inside: str = "") -> tuple[bool, int]:
    """Whether the attributes name a frame part; ``MARKED`` or ``MAIN`` if they mark the article or the main part, else 0.  ``inside`` is the
    name of an element within a marked article, where words of a name say nothing, as in share-price."""
    main = 0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True, 0
        if name in ("class", "id", "role"):
            for one in value.split():
                if inside:
                    if one in _INNER and inside not in _TEXT:
                        return True, 0
                    continue
                words = re.split(r"[^a-z0-9]+", one)
                if words[0] not in _LAYOUT and any(w in _FRAME or _STEM.match(w) for w in words):
                    return True, 0
            if name == "role" and value == "main":
                main = main or MAIN
        if name == "itemprop" and value == "articlebody":
            main = MARKED
    return False, main


def lines(page: str | None) -> tuple[list[str], bool]:
    """The text lines outside of frame elements, only those of the marked article or main part if there
    is one, and whether there is."""
    found = blocks(page)
    return [x for x, stands in found if stands != FRAME], any(stands in (MARKED, MAIN) for _, stands in found)


def blocks(page: str | None) -> list[tuple[str, int]]:
    """All text lines, each with its standing: ``MARKED``, ``MAIN`` and ``FRAME`` on a page that marks its
    article or main part, else ``OPEN`` and ``FRAME``."""
    if not page:
        return []
    out: list[tuple[str, int]] = []
    text: list[str] = []
    framed: list[str] = []
    skip: list = []  # name of the element left out and its depth
    roots: list[tuple[str, int]] = []  # elements that mark the text, and how
    marked = False
    at, size = 0, len(page)

    def flush() -> None:
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            out.append((line, OPEN if not roots else MARKED if any(how == MARKED for _, how in roots) else MAIN))

    def flush_framed() -> None:
        line = " ".join("".join(framed).split())
        framed.clear()
        if line:
            out.append((line, FRAME))

    while at < size:
        m = _TAG.search(page, at)
        end = m.start() if m else size
        if end > at:
            (framed if skip else text).append(html.unescape(page[at:end]))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        attrs = m[3] or m[6] or ""
        if skip and (name not in _INLINE or name == skip[0]):
            flush_framed()
        if skip and skip[0] in _IMPLIED and skip[1] == 1:
            holders = _IMPLIED[skip[0]]
            if holders is None:  # a paragraph ends before any block
                ended = name not in _INLINE and name not in _VOID and not (closing and name == skip[0])
            else:
                ended = (name == skip[0] and not closing) or (closing and name in holders)
            if ended:
                skip = []
        if skip:
            if name == skip[0]:
                skip[1] += -1 if closing else (not attrs.endswith("/"))
                if not skip[1]:
                    skip = []
                continue
            if name in _ROOTS and not closing and not marked and not _framed(attrs)[0]:
                skip = []  # the frame element was never closed
            elif closing and name in ("body", "html"):
                skip = []
            else:
                if name in _RAW and not closing:
                    r = _RAW[name].search(page, at)
                    at = r.end() if r else size
                continue
        if name not in _INLINE:
            flush()
        if closing:
            if any(root == name for root, _ in roots):
                while roots.pop()[0] != name:
                    pass
            continue
        if name in _VOID:
            continue
        frame, main = _framed(attrs, name if roots else "") if attrs.strip(" /") else (False, 0)
        if name in _RAW:
            r = _RAW[name].search(page, at)
            at = r.end() if r else size
            continue
        if frame and name in ("body", "html"):
            frame = False
        if frame or (name in _SKIP and not (name in ("header", "figcaption") and roots)):
            skip = [name, 1]
            continue
        if name in _ROOTS or main:
            roots.append((name, MARKED if name == "article" else main or MAIN))
            marked = True
    flush_framed()
    flush()
    if marked and any(stands in (MARKED, MAIN) for _, stands in out):
        return [(x, stands if stands in (MARKED, MAIN) else FRAME) for x, stands in out]
    return out


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def common(a: list[int], b: list[int]) -> list[int]:
    """Indexes of a in a longest common subsequence of a and b, by the places in b of a's
    lines: increasing subsequences over matches, after equal ends are taken off."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = list(range(lo)) + list(range(len(a) - hi, len(a)))
    places: dict[int, list[int]] = {}
    for j in range(lo, len(b) - hi):
        places.setdefault(b[j], []).append(j)
    if sum(len(places.get(x, ())) for x in a[lo : len(a) - hi]) > MATCHES:  # lines that recur all over both pages
        return sorted(out + [lo + i for i in _halved(np.array(a[lo : len(a) - hi]), np.array(b[lo : len(b) - hi]))])
    tails: list[int] = []
    nodes: list[tuple[int, int]] = []  # (index in a, node before)
    heads: list[int] = []
    for i in range(lo, len(a) - hi):
        for j in reversed(places.get(a[i], ())):
            k = bisect.bisect_left(tails, j)
            nodes.append((i, heads[k - 1] if k else -1))
            if k == len(tails):
                tails.append(j)
                heads.append(len(nodes) - 1)
            else:
                tails[k], heads[k] = j, len(nodes) - 1
    at = heads[-1] if heads else -1
    while at >= 0:
        out.append(nodes[at][0])
        at = nodes[at][1]
    return sorted(out)


def _halved(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indexes of a in a longest common subsequence, by halves of a; in memory for one row of lengths."""

    def lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        row = np.zeros(len(y) + 1, np.int64)
        for v in x:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == v)))
        return row

    out, work = [], [(0, a, b)]
    while work:
        at, x, y = work.pop()
        if not len(x) or not len(y):
            continue
        if len(x) == 1:
            if (y == x[0]).any():
                out.append(at)
            continue
        half = len(x) // 2
        cut = int((lengths(x[:half], y) + lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
        work += [(at, x[:half], y[:cut]), (at + half, x[half:], y[cut:])]
    return out


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [blocks(value.as_py()) for value in batch.column(2)]
        hashes = [[_hash(x) & ~3 | stands for x, stands in own] for own in found]
        every = [[x for x, _ in own] for own in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(every, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64()))], ["id", "url", "lines", "hashes"])


def frame_lines(own: list[int], near: list[list[int]], among: set[int] | None = None, whole: int | None = None, frames: frozenset = frozenset()) -> list[int]:
    """Which lines of a page (``among`` its lines, of ``whole`` that tell pages apart) belong to the
    frame that it shares with its neighbours; ``frames`` are the neighbours without their articles."""
    whole = len(own) if whole is None else whole
    found = {k: [i for i in common(own, other) if among is None or i in among] for k, other in enumerate(near) if other}
    sure = {k for k, same in found.items() if k in frames and 0 < len(same) < whole}
    hits = [same for same in found.values() if 0 < len(same) < whole]
    times: dict[int, int] = {}
    for same in hits:
        for i in same:
            times[i] = times.get(i, 0) + 1
    if len(hits) == 1:
        return sorted(times)
    out = {i for i, n in times.items() if n > 1} | {i for k in sure for i in found[k]}
    for same in hits:  # what one neighbour alone shares, unless that is most of what no other does
        alone = [i for i in same if times[i] == 1]
        if 2 * len(alone) <= whole - len(out):
            out.update(alone)
    return sorted(out) if len(out) < whole else []


def differenced(own: list[int], near: list[list[int]]) -> list[int]:
    """The places of the lines that differencing deletes; never of those in a marked article.  A line
    is its hash, with its standing in the lowest two bits."""
    stands, plain = [x & 3 for x in own], [x >> 2 for x in own]
    marks = (MARKED, MAIN)
    marked = any(x in marks for x in stands)
    among = {i for i, x in enumerate(stands) if x == (FRAME if marked else OPEN)}
    frames = frozenset(k for k, other in enumerate(near) if any(x & 3 in marks for x in other))
    gone = frame_lines(plain, [[x >> 2 for x in other if x & 3 not in marks] for other in near], among, len(own) if marked else len(among), frames)
    main = [i for i, x in enumerate(stands) if x == MAIN]
    return sorted([*gone, *(main[k] for k in main_lines([plain[i] for i in main], [[x >> 2 for x in other if x & 3 == MAIN] for other in near]))])


def main_lines(own: list[int], near: list[list[int]]) -> list[int]:
    """Which lines of a main part all neighbours' main parts share, two at least.  Copies tell nothing,
    nor does what would take most of the part: these are near copies of one article."""
    found = [same for other in near if other and len(same := common(own, other)) < len(own)]
    if len(found) < 2:
        return []
    out = sorted(set(found[0]).intersection(*found[1:]))
    return out if 2 * len(out) <= len(own) else []


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each page that it shares with its neighbours, from runs of pages in their order."""

    def give(run: list[dict]) -> pa.RecordBatch:
        found = []
        for k, row in enumerate(run):
            if row["rank"] // RUN == row["run"]:  # the others are neighbours only
                near = [x["hashes"] for x in run[max(k - NEAR, 0) : k] + run[k + 1 : k + 1 + NEAR] if x["host"] == row["host"]]
                if drop := differenced(row["hashes"], near):
                    found.append((row["row"], drop))
        ids, gone = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["row", "gone"])

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["run"] != row["run"]:
                yield give(held)
                held = []
            held.append(row)
    if held:
        yield give(held)


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars, n_shared``; ``n_shared`` counts the lines that
    differencing deletes.

    A null or empty page has the empty text.  A page without a URL, alone on its host, or among
    copies of itself only has no neighbour that tells and loses no shared lines.  Pages with equal
    paths stand in any order.  Repeated rows are pages of their own, and each other's
    copies; a null id stays null; other columns aren't read; no rows give none.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "html")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = "id long, url string, lines array<string>, hashes array<long>"
    outline = rows.transform(mapped(_outline, schema)).withColumn("row", F.monotonically_increasing_id())
    rest = F.regexp_replace(F.col("url"), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    outline = ws.save(outline.withColumns({"host": F.lower(F.regexp_extract(rest, "^[^/?#]*", 0)), "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)}), "outline")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["host", "path", "row"]
    at = F.monotonically_increasing_id()
    lined = outline.filter("url is not null and size(hashes) > 0").select("row", "host", "path", "hashes")
    dealt = lined.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"part": F.shiftright(at, 33), "nth": at.bitwiseAND(F.lit((1 << 33) - 1))}).drop("path")
    dealt = ws.save(dealt, "dealt")
    counts = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a partition
    before, starts = 0, [F.lit(-1).cast("long"), F.lit(0).cast("long")]
    for part, n in counts:
        starts += [F.lit(part).cast("long"), F.lit(before).cast("long")]
        before += n
    ranked = dealt.withColumn("rank", F.create_map(*starts)[F.col("part")] + F.col("nth")).drop("part", "nth")
    # a run of pages has the neighbours of its first and last ones too
    runs = F.array_distinct(F.array(*(F.floor((F.col("rank") + step) / RUN) for step in (-NEAR, NEAR))))
    runs = ranked.withColumn("run", F.explode(runs)).filter("run >= 0").repartition("run").sortWithinPartitions("run", "rank")
    gone = ws.save(runs.select("run", "rank", "row", "host", "hashes").transform(mapped(_shared, "row long, gone array<int>")), "gone")
    ws.drop(dealt)
    every = F.arrays_zip("lines", "hashes")
    left = F.when(F.col("gone").isNull(), every).otherwise(F.filter(every, lambda x, i: ~F.array_contains("gone", i)))
    checked = F.filter(left, lambda x: x["hashes"].bitwiseAND(F.lit(3)) != FRAME)  # frame elements no neighbour shares
    text = F.array_join(F.transform(checked, lambda x: x["lines"]), " ")
    shared = F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_shared")
    return outline.join(gone, "row", "left").select(F.col("id").alias("page_id"), "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), shared)
