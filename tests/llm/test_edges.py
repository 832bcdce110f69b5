"""Null, empty, very long, repeated and clashing rows go through every operator."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("stratloom.llm")

from stratloom.llm import alignment, decontaminate, html_diff, lexical, minhash, packing, pii, quality_model, quality_rules, secrets, sharding, suffix_tree, toxicity
from stratloom.llm.queries import tokenizer_path

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
GIANT = "x" * 5_000_000  # one word larger than a block
ROWS = [
    (1, "A plain text of several words, written here for a test of twelve words.", "en", "s", 5),
    (2, None, "en", "s", None),
    (3, "", None, None, 0),
    (4, " \t\n ", "en", "s", 4),
    (5, LONG, "en", "s", len(LONG)),
    (6, "one", "de", "s", 3),
    (7, "A plain text of several words, written here for a test of twelve words.", "en", "t", 5),
    (7, "A plain text of several words, written here for a test of twelve words.", "en", "t", 5),
    (None, "a row without an id that has a few words to score", "en", "s", 7),
    (8, "Ünïcödé \U0001f600 text\x0bwith\x0codd\rspace \x00 and   more", "xx", "s", 9),
    (9, GIANT, "en", "s", 1),
    (-3, "negative ids are ids too", "en", "s", 1),
]
CLASH = ["id", "n", "h", "c", "v", "a", "b", "row", "part", "cell", "group", "size", "rank", "entropy", "low", "x", "y", "held_out", "hub", "rep", "gone", "bucket", "length", "start", "kept", "known"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 0), (5, 1, 0), (7, None, 0), (None, 1, 0), (4, 0, 1), (1, 0, 0)], "doc_id long, quality int, toxic int").withColumn("id", F.lit(0))


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "A plain text of several words, written here for a test of twelve"), (2, None), (3, ""), (None, "x"), (4, "short")], "item_id long, text string").withColumn("id", F.lit("c"))


OPERATORS = {
    "minhash": lambda d, l, b: minhash.near_duplicates(d),
    "suffix": lambda d, l, b: suffix_tree.score_texts(d),
    "secrets": lambda d, l, b: secrets.secret_spans(d),
    "redact": lambda d, l, b: secrets.redact(d),
    "packing": lambda d, l, b: packing.pack(d, tokenizer=tokenizer_path("word_bpe_49k.json")),
    "rules": lambda d, l, b: quality_rules.quality_rules(d),
    "pii": lambda d, l, b: pii.personal_spans(d),
    "pii_redact": lambda d, l, b: pii.redact(d),
    "shards": lambda d, l, b: sharding.hilbert_shards(d),
    "model": lambda d, l, b: quality_model.quality_scores(d, l),
    "leaks": lambda d, l, b: decontaminate.leaks(d, b),
    "align": lambda d, l, b: alignment.align(d, a=tokenizer_path("byte_bpe_50k.json"), b=tokenizer_path("piece_bpe_32k.model")),
    "toxicity": lambda d, l, b: toxicity.toxic_documents(d, l),
    "search": lambda d, l, b: lexical.search(d, b),
    "html": lambda d, l, b: html_diff.main_text(d.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(name, docs, labels, benchmark):
    got = OPERATORS[name](docs, labels, benchmark).collect()
    if name == "leaks":
        assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (7, 1), (7, 1)]
    elif name == "search":  # one item has words that are in the texts
        assert {r.item_id for r in got} == {1} and [r.doc_id for r in sorted(got, key=lambda r: r["rank"])][:3] == [1, 7, 7] and len(got) > 3
    elif name == "packing":
        assert {r.doc_id for r in got} == {r[0] for r in ROWS}
        assert sum(r.piece == 0 for r in got) == len(ROWS)
    else:
        assert len(got) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, docs, labels, benchmark):
    assert OPERATORS[name](docs.filter("false"), labels, benchmark).collect() == []


def test_empty_side_tables(docs, labels, benchmark):
    assert {r.score for r in quality_model.quality_scores(docs, labels.filter("false")).collect()} == {0.5}
    assert decontaminate.leaks(docs, benchmark.filter("false")).count() == 0


def test_defined_results(docs, labels, benchmark):
    near = {(r.doc_id, r.component_id, r.kept, r.n_shingles) for r in minhash.near_duplicates(docs).collect()}
    assert (7, 1, False, 10) in near and (1, 1, True, 10) in near and (2, 2, True, 0) in near and (6, 6, True, 1) in near
    assert any(r[0] is None and r[1] is None and r[2] for r in near)
    rules = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert rules[2].base_failed and not rules[2].kept and rules[2].n_words == 0 and rules[1].kept
    scores = {r.doc_id: r for r in suffix_tree.score_texts(docs).collect()}
    assert scores[2].n_tokens == scores[3].n_tokens == 1 and scores[9].n_tokens == 2 and not scores[None].held_out
    assert all(r.score <= 0 and r.base_score < 0 for r in scores.values())
    shard = sharding.hilbert_shards(docs).collect()
    assert sorted(r.slot for r in shard if r.shard == 0) == list(range(sum(r.shard == 0 for r in shard)))
    assert {r.size for r in shard if r.doc_id in (2, 3)} == {1}
