"""Tokenizer alignment, toxicity by sentences and ranked search against brute force."""

import collections
import hashlib
import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("stratloom.llm")

from stratloom.llm import alignment, lexical, toxicity
from stratloom.llm.queries import ORACLES, QUERIES, tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
TEXTS = [
    (1, "Plain words, and more of them."),
    (2, None),
    (3, ""),
    (4, "   spaces  before,\tbetween\nand after  "),
    (5, "<|endoftext|> <s> </s> <unk> <0x41> are plain text here"),
    (6, "a mark ▁ that pieces write for a space"),
    (7, "Ünïcödé 😀 日本語のテキスト ﬁ ½ é"),
    (8, "nul \x00 and \x7f and ​"),
    (9, "Plain words, and more of them."),
    (9, "Plain words, and more of them."),
    (None, "no id but tokens"),
    (-5, "x" * 3000),
    (11, "it's they'll I'd don't 'sudden 12345 a1b2"),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("row", "pair", "n", "term", "terms", "times", "id", "y", "rank", "score", "h", "part", "toxic")}).repartition(3)


# --- alignment ---


def plain_alignment(texts):
    """What the contract says, token by token."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(A))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=tokenizer_path(B))
    letters = alignment._byte_letters()

    def piece(i):
        p = b.id_to_piece(i)
        m = re.fullmatch(r"<0x([0-9A-F]{2})>", p)
        return bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()

    per, counts = [], collections.Counter()
    for t in texts:
        t = t or ""
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        ba, bb = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia], [piece(i) for i in ib]
        if not t or not b"".join(ba) == b"".join(bb) == (" " + t).encode():
            per.append(None)
            continue
        spans = []
        for tokens in (ba, bb):
            at, out = 0, []
            for x in tokens:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, last = [], 0
        for end in ends:
            groups.append([[str(i) for i, (_, e) in zip(ids, own) if last < e <= end] for ids, own in zip((ia, ib), spans)])
            last = end
        counts.update((ia[i], ib[j]) for i, j in links)
        per.append((ia, ib, links, groups))
    best = collections.Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = []
    for p in per:
        if p is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ia, ib, links, groups = p
        n = [counts[ia[i], ib[j]] for i, j in links]
        text = ";".join("|".join(",".join(side) for side in g) for g in groups)
        out.append((len(ia), len(ib), len(groups), len(links), sum(c == best[ib[j]] for c, (_, j) in zip(n, links)), sum(n), hashlib.sha256(text.encode()).hexdigest()))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot", [alignment.HOT, 40, 1])
def test_alignment_equals_brute_force(rows, hot):
    got = alignment.align(rows, a=tokenizer_path(A), b=tokenizer_path(B), hot=hot).collect()
    want = plain_alignment([t for _, t in TEXTS])
    assert sorted(((r.doc_id is None, r.doc_id, *(r[c] for c in COLUMNS)) for r in got), key=str) == sorted(((i is None, i, *w) for (i, _), w in zip(TEXTS, want)), key=str)
    assert sum(w[0] == 0 for w in want) >= 3 and any(w[5] > w[3] for w in want)


def test_alignment_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(40)
    have = [(r.doc_id, r.text) for r in docs.collect()]
    want = dict(zip((i for i, _ in have), plain_alignment([t[:2000] for _, t in have])))
    got = alignment.align(docs.withColumn("text", F.substring("text", 1, 2000)), a=tokenizer_path(A), b=tokenizer_path(B)).collect()
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == want


def test_segments_keep_ids(monkeypatch):
    first, second = alignment.tokenizers(tokenizer_path(A), tokenizer_path(B))
    assert second.by_words
    text = " ".join(w for _, t in TEXTS for w in (t or "").split(" ")) + " it 's  fine , really.\n\n New line a  b " * 20
    for most in (1, 7, 50):
        parts = alignment.segments(text, most)
        assert len(parts) > 3 and " ".join(parts) == text
        for tok in (first, second):
            assert [i for x in tok.encode(parts) for i in x] == list(tok.encode([text])[0])
    assert alignment.segments("x" * 100, 7) == ["x" * 100]


def test_merges_give_the_ids_of_the_file(spark):
    """The quick way and the tokenizer itself, over all letters that go the quick way."""
    first, _ = alignment.tokenizers(tokenizer_path(A), tokenizer_path(B))
    assert first.merges is not None
    rng = np.random.default_rng(9)
    letters = [chr(c) for c in range(1, alignment.PLAIN)]
    texts = ["".join(rng.choice(letters, 60)) for _ in range(400)] + ["".join(f"{c}{c}a{c} {c}  {c}1" for c in letters)] + [t for _, t in TEXTS if t]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    slow = [e.ids for e in first.tokenizer.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
    assert [list(x) for x in first.encode(texts)] == slow


def test_alignment_of_no_rows(rows):
    assert alignment.align(rows.filter("false"), a=tokenizer_path(A), b=tokenizer_path(B)).collect() == []


# --- ranked search ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_search(docs, items, k, once=True):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    full = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(full), sum(n for *_, n in full)
    df = collections.Counter(t for _, b, _ in full for t in b)
    out = []
    for item, text in items:
        asked = collections.Counter(terms(text))
        scores = []
        for i, b, n in full:
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum((1 if once else asked[t]) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in asked if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("once,entries,k", [(True, lexical.ENTRIES, 50), (True, 4, 2), (False, 8, 3)])
def test_search_equals_brute_force(spark, rows, once, entries, k):
    extra = [(100 + i, f"tie words {'more ' * (i % 3)}Plain") for i in range(12)]
    items = [(1, "plain WORDS words and nothing"), (2, None), (3, " .,- "), (4, "tie"), (None, "no id"), (4, "日本語のテキスト x1"), (5, "x" * 3000 + " Ünïcödé")]
    docs = rows.select("doc_id", "text", "term", "rank").unionByName(spark.createDataFrame(extra, "doc_id long, text string").withColumns({"term": F.lit(""), "rank": F.lit("")}))
    got = lexical.search(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(1)), k=k, once=once, entries=entries).collect()
    want = plain_search(TEXTS + extra, items, k, once)
    assert sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in got), key=str) == want and len(want) >= 8


def test_search_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLES["op13_ranked_search"]).df()
    got = QUERIES["op13_ranked_search"](spark, sf_dir).toPandas()[list(want.columns)]
    key = ["item_id", "rank"]
    assert got.sort_values(key).reset_index(drop=True).equals(want.sort_values(key).reset_index(drop=True).astype(got.dtypes))
    assert 1000 < len(got) <= 40 * 50


def test_search_in_many_batches(spark, sf_dir):
    """Best lists of tasks and batches are reduced to the same rows, however the texts are dealt."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = sorted(lexical.search(docs, items, k=7).collect())
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
        assert sorted(lexical.search(docs.repartition(5), items, k=7).collect()) == one
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_search_of_empty_tables(rows, spark):
    items = spark.createDataFrame([(1, "plain")], "item_id long, text string")
    assert lexical.search(rows.filter("false"), items).collect() == []
    assert lexical.search(rows, items.filter("false")).collect() == []


def test_length_norm_beyond_64_bits():
    n = np.array([1, 10**9], np.int64)
    assert lexical.length_norm(n, 10**12, 7 * 10**14).tolist() == [50 + 50 * x * 10**12 // (7 * 10**14) for x in (1, 10**9)]


# --- toxicity ---


def test_sentences():
    texts = ["One. Two! Three?Four\nFive", "", "终了。次！ok", None, "3.5 is no end. "]
    offsets = np.append(0, np.cumsum([len((t or "").encode()) for t in texts]))
    raw = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
    starts = toxicity.sentence_starts(raw, offsets)
    whole = raw.tobytes()
    got = [whole[s:e].decode() for s, e in zip(starts, [*starts[1:], len(whole)])]
    assert got == ["One.", " Two!", " Three?Four\n", "Five", "终了。", "次！", "ok", "3.5 is no end.", " "]


def test_noisy_or_is_fitted_by_its_likelihood():
    """The learnt weights are near a minimum of the likelihood, found again by plain numbers."""
    rng = np.random.default_rng(5)
    n, f = 400, 6
    sizes = rng.integers(1, 12, n)
    x = [(rng.random((s, f)) < 0.15).astype(float) for s in sizes]
    true = np.array([6.0, 5.0, 0, 0, 0, 0])
    y = np.array([rng.random() < 1 - np.prod(1 - 1 / (1 + np.exp(5 - r @ true))) for r in x]).astype(int)
    doc, sentence, feature, times = (np.concatenate(p) for p in zip(*[(np.full(int((r > 0).sum()), i), *np.nonzero(r), np.ones(int((r > 0).sum()))) for i, r in enumerate(x)]))
    w, bias, leak = toxicity.fit(doc, sentence, feature, times, sizes, y, np.ones(n), f, steps=1500, rate=0.05)

    def loss(w, bias, leak):
        out = 0.0
        for r, t in zip(x, y):
            s = toxicity.softplus(bias + r @ w).sum() + toxicity.softplus(np.array([leak]))[0]
            out += s if t == 0 else -math.log(max(-math.expm1(-s), 1e-12))
        return out / n + 2e-4 * np.abs(w).sum()

    best = loss(w, bias, leak)
    for i in range(f):
        for step in (-0.3, 0.3):
            moved = w.copy()
            moved[i] += step
            assert loss(moved, bias, leak) > best - 1e-3
    assert min(w[:2]) > 3 and np.abs(w[2:]).max() < 1


def test_toxicity_held_out(spark, sf_dir):
    """Held-out labels, and the sentences that explain them."""
    got = QUERIES["op12_toxic_sentences"](spark, "/root/testdata/sf0.01").toPandas()
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic").toPandas()
    held = got[got.held_out].merge(marks, on="doc_id")
    assert (held.predicted == held.toxic).mean() > 0.93 and got.score.between(0, 1).all()
    assert got[(got.predicted == 1) & (got.score > 0.9)].n_toxic.gt(0).mean() > 0.9
    clean = marks[marks.toxic == 0].merge(got, on="doc_id")
    assert (clean.predicted == 0).mean() > 0.98


def test_toxic_sentences_are_located(spark):
    good = [(i, f"Here is a calm text number {i}. It has words and more words. All is fine.", 0) for i in range(60)]
    bad = [(100 + i, f"Ünï here is a calm text {i}. You are a grumbleface indeed! All is fine.", 1) for i in range(40)]
    df = spark.createDataFrame([*good, *bad], "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity.toxic_documents(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    for i, text, y in [*good, *bad]:
        assert got[i].predicted == y
        assert [text[s.start : s.end] for s in got[i].toxic] == ([" You are a grumbleface indeed!"] if y else [])
        assert all(s.score >= 0.5 for s in got[i].toxic)


def test_toxicity_edges(spark, rows):
    marks = spark.createDataFrame([(1, 0), (9, 1), (None, 1), (4, None), (11, 0), (1, 1)], "doc_id long, toxic int").withColumn("id", F.lit(1))
    for labels in (marks, marks.filter("false"), marks.filter("toxic = 0"), marks.filter("doc_id = 1")):
        got = toxicity.toxic_documents(rows, labels).collect()
        assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
        same = {(r.score, r.predicted) for r in got if r.doc_id == 9}
        assert len(same) == 1
        assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert {r.score for r in toxicity.toxic_documents(rows, marks.filter("false")).collect()} == {0.5}
    assert toxicity.toxic_documents(rows.filter("false"), marks).collect() == []
