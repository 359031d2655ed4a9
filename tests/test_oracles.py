"""Every query with an oracle gives the oracle's rows on the small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from loomline import queries as timeline

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = timeline.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iufb":
            df[c] = df[c].astype("float64").round(6)
        else:
            try:
                df[c] = pd.to_numeric(df[c]).astype("float64").round(6)
            except (TypeError, ValueError):
                df[c] = df[c].map(lambda x: None if x is None or x != x else str(x)).astype(object)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    got, want = normal(QUERIES[name](spark, DIR).toPandas()), normal(duck.sql(SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
