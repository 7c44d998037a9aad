"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

from tessarine.plans import catalog

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert sorted(got) == sorted(want) and len(got) == len(want) > 0 or name in ("jaccard_relations",)
    columns = sorted(got)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-9, rtol=0)


def test_splits_are_disjoint_and_whole(spark):
    kg = catalog.star_triples(spark, SF)
    n = kg.count()
    for name in ("random_split", "coverage_split"):
        parts = catalog.QUERIES[name](spark, SF)
        assert parts.count() == parts.select("h", "r", "t").distinct().count() == n
        assert {r.part: r["count"] for r in parts.groupBy("part").count().collect()}[0] == int(0.8 * n + 1e-9)
    covered = catalog.QUERIES["coverage_split"](spark, SF).where("part = 0")
    assert covered.select("r").distinct().count() == kg.select("r").distinct().count()
    ends = lambda df: df.select("h").union(df.select("t")).distinct().count()
    assert ends(covered) == ends(kg)


def test_inductive_splits(spark):
    semi = catalog.QUERIES["semi_inductive_split"](spark, SF).collect()
    inside = {x for r in semi if r.part == 0 for x in (r.h, r.t)}
    assert all(r.h in inside or r.t in inside or r.part > 0 for r in semi)
    full = catalog.QUERIES["fully_inductive_split"](spark, SF).collect()
    ends = [{x for r in full if r.part == p for x in (r.h, r.t)} for p in (0, 1)]
    assert ends[0] and ends[1] and not ends[0] & ends[1]


def test_negatives_differ_from_their_positives(spark):
    for name in ("basic_negatives", "bernoulli_negatives"):
        for r in catalog.QUERIES[name](spark, SF).collect():
            assert (r.h != r.positive_h) if r.corrupted_head else (r.h == r.positive_h and r.t != r.positive_t)
    kg = {(r.r, r.t) for r in catalog.star_triples(spark, SF).collect()}
    assert all((r.r, r.negative) in kg and r.negative != r.t for r in catalog.QUERIES["pseudo_typed_negatives"](spark, SF).collect())
