"""Every query with an SQL definition gives its rows on the smallest tables; the others give some."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from helpers import DATA

from strictpast import queries

TABLES = "region nation customer supplier part orders lineitem events".split()
SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
        if df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]")
    text = df.astype(str)
    return text.sort_values(list(text.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "history_incremental_7_batches"])
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.ORACLES:
        assert len(found)
        return
    expected = duck.sql(queries.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    pd.testing.assert_frame_equal(canonical(found), canonical(expected))


def test_plans_have_no_python(spark):
    for name in ("history_all_events", "ote_train_interactions", "segment_errors"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_entry_points(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
    assert np.isfinite(1.0)
