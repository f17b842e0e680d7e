"""Every registered query of the engine gives the rows of its SQL on the smallest tables."""

import datetime
import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from recollect.plans import registry


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "None"
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, (float, np.floating)):
        return repr(round(float(x), 6) + 0.0).removesuffix(".0")
    if isinstance(x, (pd.Timestamp, datetime.datetime)):
        return str(pd.Timestamp(x).tz_localize(None))
    return str(x)


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


#: Empty on the smallest tables only.
MAY_BE_EMPTY = {"by_source_hash", "proposal_apply", "merge_aliases", "contradiction_pairs", "synthesis_clusters"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_parity(spark, duck, data, name):
    got = registry.queries()[name](spark, data).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
    assert len(got) or name in MAY_BE_EMPTY


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
