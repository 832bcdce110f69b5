import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def rows(frame):
    import math

    clean = lambda x: None if x is None or x != x else round(float(x), 5) if isinstance(x, float) else bool(x) if type(x).__name__ in ("bool", "bool_") else int(x) if "int" in type(x).__name__ else str(x)
    out = [tuple(clean(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r)), math


GRID = ["lattice_index", "voxel_coverage", "idw_impute", "block_ids", "buffer_roles", "tolerance_join", "pooled_metrics", "brier_auc", "ks_stat", "wilcoxon_w", "config_ranking", "spike_index", "speck_bands", "connectivity", "krige_given_alpha"]
GRID += ["tree_levels", "group_roles", "fold_search", "block_merge", "cv_nn_distance", "deploy_nn_distance", "selectivity", "quantile_errors", "ecdf", "size_sweep", "provenance_join", "voxel_coverage_k5"]


@pytest.mark.parametrize("name", GRID)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want, _ = rows(con.execute(entry.oracle_sql()[name]).df())
    got, _ = rows(entry.queries()[name](spark, sf_dir).toPandas())
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-5)
