"""Every query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quire.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and pd.isna(v)):
            return "null"
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    cols = sorted(df.columns)
    out = pd.DataFrame({c: df[c].astype("object").map(text) for c in cols})
    return out.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), db.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) and (not len(got) or tidy(got).equals(tidy(want)))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
