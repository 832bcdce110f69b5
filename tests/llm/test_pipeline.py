"""Each stage on nulls, empty and long texts, repeated ids and rows, clashing names and no rows."""

import importlib.util

import pytest
from pyspark.sql import functions as F

pytest.importorskip("stratloom.llm")
if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)

import corpus_pipeline as pipeline
from stratloom.llm import _store

PROSE = "The committee met on a cold morning in March and spoke at length about the old bridge over the river near town"
OTHER = "Several farmers brought their finest apples to the autumn market where children ran between the wooden stalls laughing"
JUNK = " ".join(f"word{i}### thing{i}$$$" for i in range(40))
ROWS = [
    (1, PROSE, "en"),
    (2, None, "en"),
    (3, "", None),
    (4, JUNK, "en"),
    (5, OTHER + " and password = hunter2hunter was written on the wall", "en"),
    (7, PROSE, "en"),  # a copy of 1
    (7, OTHER + " until the late evening came and all of them went home", "en"),  # another text under an id that goes
    (8, PROSE.replace("cold", "grey") + " first", "en"),
    (8, PROSE.replace("cold", "grey") + " first", "en"),
    (None, JUNK + " x", "en"),
    (None, "A row without an id that has enough words of its own to pass all the rules of the first stage", "en"),
    (None, "A row without an id that has enough words of its own to pass all the rules of the first stage", "en"),
    (9, " ".join(f"{a}{b}{c}" for a in ("north", "south", "east") for b in ("field", "stone", "water", "light") for c in ("man", "side", "wood", "path", "gate")) * 200, "en"),
]
CLEAN = [(1000 + i, f"In the year {i} the town of number {i * 7} built a house with {i} windows and a garden full of red and white flowers", "en") for i in range(0, 900, 30)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS + CLEAN, "doc_id long, text string, lang string")
    names = ["key", "_key", "key_again", "id", "n", "h", "row", "kept", "component_id", "lines", "gone"]
    return df.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), **{c: F.lit("clash") for c in names}}).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    items = [(1, ROWS[10][1][2:80]), (2, None), (None, PROSE), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def texts(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in df.collect() if r.doc_id is None or r.doc_id < 1000 if r.text)


@pytest.mark.parametrize("most", [_store.MOST_IDS, 0])
def test_rules(spark, docs, folder, monkeypatch, most):
    monkeypatch.setattr(_store, "MOST_IDS", most)
    monkeypatch.setattr(pipeline, "MOST_IDS", most)
    out = pipeline.rules_stage(spark, docs, folder)
    assert out.columns == docs.columns
    got = texts(out)
    assert [t for _, t in got].count(ROWS[10][1]) == 2 and not any("###" in t for _, t in got)
    assert (1, PROSE) in got and (7, ROWS[6][1]) in got and not any(r.text in (None, "") for r in out.collect())


def test_dedup(spark, docs, folder):
    out = pipeline.dedup_stage(spark, docs, folder)
    assert out.columns == docs.columns
    got = texts(out)
    assert (1, PROSE) in got and (7, PROSE) not in got and (7, ROWS[6][1]) in got
    assert sum(i == 8 for i, _ in got) <= 1 and sum(t == ROWS[10][1] for _, t in got) == 1
    assert out.filter("text is null or text = ''").count() == 2


def test_decontamination(spark, docs, folder):
    out = pipeline.decontamination_stage(spark, docs, folder)
    assert out.columns == docs.columns
    assert docs.count() - out.count() == 2 and out.filter("doc_id is null").count() == 1


def test_secrets(spark, docs, folder):
    out = pipeline.secrets_stage(spark, docs, folder)
    assert out.columns == docs.columns and out.count() == docs.count()
    row = out.filter("doc_id = 5").first()
    assert "hunter2" not in row.text and row.n_chars == len(row.text)
    assert "n_chars" not in pipeline.secrets_stage(spark, docs.drop("n_chars"), folder).columns


def test_packing(spark, docs, folder):
    out = pipeline.packing_stage(spark, docs, folder).collect()
    assert sum(r.piece == 0 for r in out) == docs.count() and max(r.offset + r.length for r in out) <= 2048
    assert sum(r.doc_id is None for r in out) == 3


def test_no_rows(spark, docs, folder):
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.filter("false"), folder).count() == 0
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/none/benchmark.parquet")
    assert pipeline.decontamination_stage(spark, docs, f"{folder}/none").count() == docs.count()


def test_a_stage_begins_with_executors_that_let_go(spark, sf_dir):
    def collected():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = collected()
    pipeline.secrets_stage(spark, docs, sf_dir)
    assert collected() > before
