"""Queries with areas on tables whose rows reach far beyond the pole, as those of larger tables do."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_queries import plain
from zonalis.functions.geodesy import MAJOR, MINOR, pixel_area_ha
from zonalis.queries import ORACLE_SQL, QUERIES

FAR = ["alias", "group_one", "lineitem_ship_week", "auto_area_layer", "derived_times_area", "lineitem_filtered_area", "zonal_sum_area"]


@pytest.fixture(scope="module")
def far(sf_dir, tmp_path_factory):
    """sf0.001 three times, with keys as in tables 1, 6 and 50 times sf0.1."""
    path, con = str(tmp_path_factory.mktemp("far")), duckdb.connect()
    for table, keys in (("events", {"event_id": 100_000, "user_id": 1500}), ("lineitem", {"l_orderkey": 150_000, "l_partkey": 20_000, "l_suppkey": 1000})):
        shifted = ", ".join(f"{k} + i * {n} AS {k}" for k, n in keys.items())
        con.execute(f"COPY (SELECT t.* REPLACE ({shifted}) FROM (VALUES (0), (5), (49)) r(i), '{sf_dir}/{table}.parquet' t) TO '{path}/{table}.parquet'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    return path, con


@pytest.mark.parametrize("name", FAR)
def test_query_beyond_the_pole(spark, far, name):
    path, con = far
    got, want = QUERIES[name](spark, path).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
    assert len(got) > 0


def test_area_keeps_its_digits(spark):
    """Against the surface element at the pixel's centre, which is off by 1e-12 for pixels so small."""
    width, e2 = 0.00025, 1 - (MINOR / MAJOR) ** 2
    at = [0.0, 4.375, 60.625, 89.375, 119.375, 749.375]
    got = [r[0] for r in spark.createDataFrame([(y,) for y in at], "y double").select(pixel_area_ha(F.col("y"), width)).collect()]
    middle = [math.radians(y + width / 2) for y in at]
    want = [MINOR**2 * math.cos(m) / (1 - e2 * math.sin(m) ** 2) ** 2 * math.radians(width) ** 2 / 10000 for m in middle]
    assert got == pytest.approx(want, rel=4e-12) and got[4] < 0 < got[3]
