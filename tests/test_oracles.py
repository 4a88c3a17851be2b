"""Every query with SQL gives the SQL's rows."""

import math

import duckdb
import pytest

from corvane.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def rows(df):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "-"
        x = x.item() if hasattr(x, "item") else x
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else repr(x)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, data, duck, name):
    assert rows(QUERIES[name](spark, data).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
