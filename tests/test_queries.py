"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from quillspark.plans import all_queries, all_sql

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(frame):
    def show(v):
        if v is None or (isinstance(v, float) and np.isnan(v)):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.integer, np.floating)):
            return f"{float(v):.6f}"
        return str(v)

    return sorted(tuple(show(None if v is not None and v is not v else v) for v in row) for row in frame[sorted(frame.columns)].astype(object).where(frame.notna(), None).to_numpy())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    found = all_queries()[name](spark, DATA).toPandas()
    if name not in all_sql():
        assert len(found.columns) and len(found) > 0
        return
    wanted = duck.sql(all_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert plain(found) == plain(wanted)
