"""Every registered query with SQL gives the rows that DuckDB gives, at the smallest size."""

import duckdb
import pytest

from clicklog.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (x[cols].sort_values(cols, ignore_index=True) for x in (got, want))
    assert len(got) == len(want)
    for c in cols:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if got[c].dtype.kind == "f":
            same |= (got[c] - want[c].astype(float)).abs() < 2e-6
        assert same.all(), c


@pytest.mark.parametrize("name", ["deep_attraction", "deepcross_attraction", "fit_pbm", "fit_ccm", "fit_deep_ctr", "fit_mixture", "fit_pbm_deepcross", "fit_pbm_two_tower", "fit_pbm_attention", "fit_dbn_deep", "fit_dctr_robe"])
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
