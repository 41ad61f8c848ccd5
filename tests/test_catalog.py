"""Every registered query with SQL gives the rows that DuckDB gives for it."""

import duckdb
import pytest

from tracemill import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(4)
    text = df.astype(str).replace({"None": "nan", "<NA>": "nan"})
    text = text.replace(r"\.0$", "", regex=True)
    return sorted(map(tuple, text.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DIR).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
