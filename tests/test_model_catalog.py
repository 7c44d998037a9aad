import glob
import os

import duckdb
import pandas as pd
import pytest

from tessarine.plans import catalog, model_catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", model_catalog.NAMES)
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    if name not in catalog.ORACLES:
        return
    want = con.sql(catalog.ORACLES[name]).df()
    columns = sorted(got)
    assert columns == sorted(want) and len(got) == len(want)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6, rtol=0)
