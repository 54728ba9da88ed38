"""Every registered query of the library against its SQL in DuckDB."""

import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from millrace import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and np.isnan(v)):
        return None
    return round(float(v), 4) if isinstance(v, (float, np.floating)) else str(v) if isinstance(v, pd.Timestamp) else v


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-4 * max(1.0, abs(a)))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = plans.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    cursor = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert sorted(names) == columns
    if Counter(got) != Counter(want):
        pairs = zip(sorted(got, key=repr), sorted(want, key=repr), strict=True)
        assert all(all(map(close, a, b)) for a, b in pairs)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql(spark, sf_dir, name):
    rows = plans.queries()[name](spark, sf_dir).collect()
    assert rows
    if name == "powerlaw_grid_fit":
        assert (rows[0].alpha, rows[0].beta, rows[0].e, rows[0].at_edge) == (0.34, 0.28, 1.69, False)
    if name == "agg_approx_distinct":
        exact = {r.event_type: r.n for r in spark.sql(f"select event_type, count(distinct user_id) n from parquet.`{sf_dir}/events.parquet` group by 1").collect()}
        assert all(abs(r.users - exact[r.event_type]) <= 0.1 * exact[r.event_type] + 1 for r in rows)


def test_entry_without_the_subpackage():
    import __spark_entry__

    assert set(plans.queries()) <= set(__spark_entry__.queries()) and os.path.exists(__spark_entry__.__file__)
