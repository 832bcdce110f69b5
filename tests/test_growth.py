"""Trees as aggregates, runs that are taken up again, workbooks and covariance in blocks, against plain Python."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratloom.operators import growth, kriging
from stratloom.operators.lineage import settle
from stratloom.operators.runs import Manifest
from stratloom.sources import readers, sheets


def plain_tree(x, y, w, depth, least, names):
    """node -> (n, value, feature, bin) by trying every split of binned rows."""
    out = {}

    def go(node, rows, level):
        n, s = w[rows].sum(), (w[rows] * y[rows]).sum()
        best = None
        if level < depth and n >= 2 * least:
            for f in names(node):
                for b in sorted(set(x[rows, f])):
                    left = rows[x[rows, f] <= b]
                    ln, ls = w[left].sum(), (w[left] * y[left]).sum()
                    if ln >= least and n - ln >= least:
                        gain = round(ls**2 / ln + (s - ls) ** 2 / (n - ln) - s**2 / n, growth.DIGITS)
                        if gain >= 1e-6 and (best is None or gain > best[0]):
                            best = (gain, f, b)
        out[node] = (n, s / n, best and best[1], best and best[2])
        if best:
            side = x[rows, best[1]] <= best[2]
            go(2 * node + 1, rows[side], level + 1)
            go(2 * node + 2, rows[~side], level + 1)

    go(0, np.arange(len(y)), 0)
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(90, 4)), 1)
    y = np.round(3 * (x[:, 0] > 0.2) + x[:, 2] + rng.normal(size=90) * 0.3, 3)
    rows = [(i, [None if (i, j) == (3, 1) else float(v) for j, v in enumerate(a)], float(b), int(i % 3)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "sample int, x array<double>, y double, fold int")


def test_bins_follow_ranks(table):
    for bins in (100, 8):
        rows, ends = growth.binned(table, bins)
        got = {r.sample: r.bins for r in rows.collect()}
        by = {(r.feature, r.bin): (r.lo, r.hi) for r in ends.collect()}
        source = {r.sample: r.x for r in table.collect()}
        assert got[3][1] == -1 and set(got) == set(source)
        for i, x in source.items():
            for f, v in enumerate(x):
                if v is not None:
                    lo, hi = by[f, got[i][f]]
                    assert lo <= v <= hi
        n = {f: len({x[f] for x in source.values() if x[f] is not None}) for f in range(4)}
        assert {f: max(b for g, b in by if g == f) + 1 for f in range(4)} == {f: min(v, bins) for f, v in n.items()}


@pytest.mark.parametrize("bins", [100, 6])
def test_growth_equals_recursion(spark, table, bins):
    """Several jobs with limits of their own grow at once, with weights."""
    rows, ends = growth.binned(table, bins)
    limits = {0: (3, 2), 1: (2, 8), 2: (0, 1), 3: (4, 30)}
    members = rows.withColumn("job", F.explode(F.array(*map(F.lit, limits)))).filter("job <> fold or job > 2").select(F.col("job").cast("long").alias("job"), F.lit(7).alias("tree"), (1 + F.col("sample") % 3).cast("long").alias("w"), "y", "bins", "sample")
    jobs = spark.createDataFrame([(j, d, n, None) for j, (d, n) in limits.items()], "job long, depth int, least int, mtry int")
    nodes = growth.grow(members.drop("sample"), jobs, ends)
    got = {(r.job, r.node): r for r in nodes.collect()}
    own = members.collect()
    size = 0
    for j, (depth, least) in limits.items():
        mine = [r for r in own if r.job == j]
        x, y, w = np.array([r.bins for r in mine]), np.array([r.y for r in mine]), np.array([r.w for r in mine], float)
        want = plain_tree(x, y, w, depth, least, lambda node: range(4))
        size += len(want)
        for node, (n, value, f, b) in want.items():
            r = got[j, node]
            assert (r.n, r.feature, r.bin) == (n, f, b) and r.value == pytest.approx(value)
    assert len(got) == size > 12
    source = {r.sample: r.x for r in table.collect()}
    for r in own:  # cuts say of values what bins say of ranks
        root = got[r.job, 0]
        v = source[r.sample][root.feature] if root.feature is not None else None
        if v is not None:
            assert (v <= root.cut) == (r.bins[root.feature] <= root.bin)
    found = {(r.job, r.sample, r.depth): r.value for r in growth.predict(members.select("job", "sample", "bins"), nodes, (1, 9)).collect()}
    for r in own:
        for depth in (1, 9):
            at = 0
            for _ in range(depth):
                n = got[r.job, at]
                if n.feature is None:
                    break
                at = 2 * at + (2 if r.bins[n.feature] > n.bin else 1)
            assert found[r.job, r.sample, depth] == pytest.approx(got[r.job, at].value)


def test_nodes_draw_their_features(spark, table):
    rows, ends = growth.binned(table)
    members = rows.select(F.lit(0).cast("long").alias("job"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("tree"), F.lit(1).cast("long").alias("w"), "y", "bins")
    jobs = spark.createDataFrame([(0, 1, 2, 1)], "job long, depth int, least int, mtry int")
    roots = growth.grow(members, jobs, ends).filter("node = 0").collect()
    assert len(roots) == 20 and len({r.feature for r in roots}) > 1


def test_bootstrap_counts(spark):
    d = growth.bootstrap(spark.range(2000).select(F.lit(0).alias("job"), F.col("id").alias("sample")), 5)
    per = d.groupBy("tree").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
    assert len(per) == 5 and all(abs(r.w - 2000) < 200 and abs(r.n - 2000 * (1 - 1 / np.e)) < 120 for r in per)


def test_a_level_is_one_aggregation_of_bins(spark, table):
    rows, ends = growth.binned(table)
    members = settle(rows.select((F.col("sample") % 2).cast("long").alias("job"), F.lit(0).alias("tree"), F.lit(0).cast("long").alias("node"), F.lit(1).cast("long").alias("w"), "y", "bins"))
    jobs = settle(spark.createDataFrame([(0, 2, None), (1, 2, 3)], "job long, least int, mtry int"))
    text = growth.splits(members, jobs, ends)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Cartesian" not in text and "partial_sum" in text


# --- runs ---


def test_a_killed_run_is_taken_up(spark, tmp_path):
    arms = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "arm string, n int")
    seen = []

    def compute(arm, fail=None):
        if arm["arm"] == fail:
            raise RuntimeError("killed")
        seen.append(arm["arm"])
        return spark.range(arm["n"]).withColumn("n", F.lit(arm["n"]))

    runs = Manifest(spark, f"file://{tmp_path}/run")
    with pytest.raises(RuntimeError):
        runs.run(arms, lambda arm: compute(arm, "b"))
    assert seen == ["a"] and [r.arm for r in runs.finished().collect()] == ["a"]
    (tmp_path / "run" / "aside" / "left").mkdir(parents=True)  # what a killed writer leaves counts for nothing
    assert Manifest(spark, f"file://{tmp_path}/run").run(arms, compute) == ["b", "c"]
    assert runs.run(arms, compute) == [] and seen == ["a", "b", "c"]
    assert sorted((r.arm, r.n) for r in runs.rows().collect()) == [("a", 1), ("b", 2), ("b", 2), ("c", 3), ("c", 3), ("c", 3)]
    runs.commit("a", spark.range(9).withColumn("n", F.lit(9)))  # an arm that is there stays
    assert runs.rows().filter("arm = 'a'").count() == 1


# --- workbooks ---


def workbook(path, rows, shared=True):
    texts = sorted({v for row in rows for v in row if isinstance(v, str)})
    letter = lambda n: (chr(64 + n // 26) if n >= 26 else "") + chr(65 + n % 26)

    def cell(r, c, v):
        at = f'r="{letter(c)}{r}"'
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c {at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, str):
            return f'<c {at} t="s"><v>{texts.index(v)}</v></c>' if shared else f'<c {at} t="inlineStr"><is><t>{v}</t></is></c>'
        return f"<c {at}><v>{v}</v></c>"

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(f'<row r="{n}">{"".join(cell(n, c, v) for c, v in enumerate(row))}</row>' for n, row in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="notes" sheetId="1" r:id="rId9"/><sheet name="data" sheetId="2" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet2.xml"/><Relationship Id="rId9" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row><c t="inlineStr"><is><t>only</t></is></c></row></sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{t[:1]}</t></r><r><t>{t[1:]}</t></r><rPh><t>x</t></rPh></si>" for t in texts) + "</sst>")


GRID = [["XC", "yc", "ZC", "FE", "FEO", "Magsus", "S", "DTR", "Magnetic"], [0, 5, 2.5, 1.25, "-", 3, 4, 55, 60], [5, 5, 2, None, 2, 3, "nan", None, 61], ["-", 1, 1, 1, 1, 1, 1, 1, 1], [None] * 9]


@pytest.mark.parametrize("shared", [True, False])
def test_a_workbook_reads_as_its_csv(spark, tmp_path, shared):
    workbook(tmp_path / "s.xlsx", GRID, shared)
    (tmp_path / "s.csv").write_text("\n".join(",".join("" if v is None else str(v) for v in row) for row in GRID[:-1]) + "\n")
    one, two = (readers.read_samples(spark, f"file://{tmp_path}/s.{kind}") for kind in ("xlsx", "csv"))
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() == 3
    assert readers.read_grid(spark, f"file://{tmp_path}/s.xlsx").count() == 2
    assert [list(r) for r in sheets.read_sheets(spark, f"file://{tmp_path}/s.xlsx", "data").collect()] == [] == sheets.read_sheets(spark, f"file://{tmp_path}/s.xlsx", 1).collect()


def test_many_workbooks_are_one_table(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["p", "q"], [1, True], [2, "x"]])
    workbook(tmp_path / "b.xlsx", [["q", None, "r"], ["y", "lost", 3]], False)
    workbook(tmp_path / "c.xlsx", [])
    got = sheets.read_sheets(spark, f"file://{tmp_path}/*.xlsx")
    assert sorted(got.columns) == ["p", "q", "r"]
    assert sorted(map(str, (r.asDict() for r in got.select("p", "q", "r").collect()))) == sorted(map(str, [{"p": "1", "q": "true", "r": None}, {"p": "2", "q": "x", "r": None}, {"p": None, "q": "y", "r": "3"}]))


# --- covariance in blocks ---


@pytest.mark.parametrize("block,side", [(256, 400), (7, 400), (7, 2)])
def test_blocks_give_the_same_covariance(spark, monkeypatch, block, side):
    monkeypatch.setattr(kriging, "BLOCK", block)
    monkeypatch.setattr(kriging, "SIDE", side)
    rng = np.random.default_rng(1)
    at = rng.random((40, 3)) * 50
    model = kriging.Covariance(((1.0, 0, 0), (0, 1.0, 0), (0, 0, 1.0)), (20.0, 15.0, 10.0))
    df = spark.createDataFrame([(i, *map(float, a), float(i % 5 - 2), 10.0) for i, a in enumerate(at)], "node_id int, x double, y double, z double, alpha double, m double")
    pairs = kriging.covariance_pairs(df, model)
    got = {(r.a, r.b): r["cov"] for r in pairs.collect()}
    want = model.matrix(at)
    assert len(got) == 1600 and all(got[i, j] == pytest.approx(want[i, j]) for i in range(40) for j in range(40))
    krig = {r.node_id: r.krig for r in kriging.krige(df, df, model).collect()}
    alpha = np.array([i % 5 - 2 for i in range(40)], float)
    assert [krig[i] for i in range(40)] == pytest.approx((10 + model.cross(at, at) @ alpha).tolist())
    if side == 2:
        assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()
