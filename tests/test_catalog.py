"""Every registered query against its SQL, over the small tables."""

import math

import duckdb
import pandas as pd
import pytest

from pulsegrid.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    return v.item() if hasattr(v, "item") else v


def rows(frame):
    out = [tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)]
    return sorted(out, key=lambda r: tuple((x is None, x if isinstance(x, (int, float)) else 0, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, duck, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
