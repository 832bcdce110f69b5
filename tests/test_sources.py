import pytest
from pyspark.sql import functions as F

from stratloom.sources import readers, synthetic


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "grid.csv")
    with open(path, "w") as f:
        f.write("xc,YC,ZC,fe,FeO,MagSus,S,DTR,Magnetic,IJK\n0,0,0,1.5,-,NaN,,3,4,0_0_0\n-,0,0,1,1,1,1,1,1,0_0_1\n5,0,0,x,2,3,4,-,-,1_0_0\n")
    g = readers.read_grid(spark, path)
    assert g.columns[:9] == [*readers.COORDS, *readers.COVARIATES, *readers.RESPONSES]
    rows = {r.XC: r for r in g.collect()}
    assert set(rows) == {0.0, 5.0} and rows[0.0].Fe == 1.5 and rows[0.0].FeO is None and rows[0.0].MagSus is None and rows[5.0].Fe is None
    readers.write_csv(g.select("XC", (F.col("Fe") / 7).alias("v")), str(tmp_path / "out.csv"), 3)
    assert sorted(r.v or "" for r in readers.read_table(spark, str(tmp_path / "out.csv")).collect()) == ["", "0.214"]


def test_missing_columns_are_named(spark):
    with pytest.raises(readers.SchemaError, match="Fe"):
        readers.match_columns(spark.createDataFrame([(1,)], "x int"), ["X", "Fe"])


def test_fallback_names(spark):
    df = readers.match_columns(spark.createDataFrame([(1.0, 2)], "x double, other int"), ["XC"], {"XC": ("X",)})
    assert df.columns == ["XC", "other"]


def test_json_and_contract(spark, tmp_path):
    readers.write_json(spark, {"b": 1, "a": [2]}, str(tmp_path / "r"))
    assert readers.read_json(spark, str(tmp_path / "r")) == {"a": [2], "b": 1}
    assert readers.contract_hash({"a": 1, "b": 2}) == readers.contract_hash({"b": 2, "a": 1}) != readers.contract_hash({"a": 1, "b": 3})


def test_matrix_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0], "m")], "id int, features array<double>, method string")
    readers.write_matrix(df, str(tmp_path / "m"), by="method")
    assert readers.read_table(spark, str(tmp_path / "m")).first().features == [1.0, 2.0]


def test_newest_run(spark):
    r = spark.createDataFrame([("A", "r1", 1, True), ("A", "r2", 2, True), ("A", "r3", 3, False), ("B", "r9", 1, True)], "kind string, run string, modified int, complete boolean")
    assert {(x.kind, x.run) for x in readers.newest_run(r).collect()} == {("A", "r2"), ("B", "r9")}
    assert {(x.kind, x.run) for x in readers.newest_run(r, by="run").collect()} == {("A", "r2"), ("B", "r9")}


def test_settings(spark):
    assert readers.Settings.of(spark).kernel == 3
    assert readers.data_path({"data": {"grid": "g"}}, "/r/", "grid") == "g" and readers.data_path({}, "/r/", "grid") == "/r/grid"


def test_deposit(spark):
    d = synthetic.deposit(spark, (12, 10, 16), holes=10)
    r = d.agg(F.count("*").alias("n"), F.count("Fe").alias("fe"), F.count("DTR").alias("dtr"), F.count_if(F.col("DTR").isNotNull() & F.col("Fe").isNull()).alias("off")).first()
    assert r.n == 12 * 10 * 16 and 0 < r.dtr < r.fe < 0.16 * r.n and r.off == 0
    assert d.filter("Fe is not null").agg(F.stddev("Fe")).first()[0] > 0
