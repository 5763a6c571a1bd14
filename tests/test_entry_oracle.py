"""Driver contract and a DuckDB cross-check at the smallest scale."""
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from scrubline.plans.oracle import oracle_sql
from scrubline.plans.queries import QUERIES
from scrubline.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
ORACLE = oracle_sql()


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["src", "doc_id", "sanitized"]
    assert df.count() > 0


def test_every_query_has_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql()) <= set(E.queries())


def _canon(df):
    cols = sorted(df.columns)

    def norm(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, float):
            return round(v, 9)
        return v.item() if hasattr(v, "item") else v
    rows = [tuple(norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sp = QUERIES[name](spark, SF).toPandas()
    dk = con.execute(ORACLE[name]).df()
    assert _canon(sp) == _canon(dk)
