"""Every registered query of the engine against its SQL, over whole tables."""

import os

import duckdb
import pandas as pd
import pytest

from zonalis.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    rows = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    return sorted((tuple(float(v) if isinstance(v, int | float) and not isinstance(v, bool) else None if v is None else str(v) for v in r) for r in rows.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
    assert len(got) > 0
