"""Pixel tables over the star-schema tables, and their catalogue: stand-ins for raster files."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import Catalog

EVENTS_ENVIRONMENT = [
    {"name": "event__type", "no_data": 0, "raster_table": {"rows": [{"value": 1, "meaning": "click"}, {"value": 2, "meaning": "error"}, {"value": 3, "meaning": "purchase"}, {"value": 4, "meaning": "signup"}]}},
    {"name": "class__k", "no_data": 0, "raster_table": {"rows": [{"value": k, "meaning": "Low" if k < 30 else "Mid" if k < 60 else "High"} for k in range(1, 99)], "default_meaning": "Unknown"}},
    {"name": "percent__k", "no_data": 99},
    {"name": "any__k", "no_data": None},
    {"name": "loss__year", "no_data": 0, "raster_table": {"rows": [{"value": k, "meaning": 2000 + k} for k in range(1, 21)]}},
    {"name": "alert__date_conf", "no_data": 0},
    {"name": "alert__date", "no_data": 0, "source_layer": "alert__date_conf", "calc": "A - 8192 * floor(A / 8192)", "decode_expression": "(A + 16435).astype('datetime64[D]').astype(str)", "encode_expression": "datetime64(A) - 16435"},
    {"name": "alert__confidence", "no_data": 0, "source_layer": "alert__date_conf", "calc": "floor(A / 8192)", "raster_table": {"rows": [{"value": 2, "meaning": ""}, {"value": 3, "meaning": "high"}]}},
    {"name": "value__per_ha", "no_data": "nan"},
    {"name": "value__total", "no_data": "nan", "source_layer": "value__per_ha", "calc": "A * area"},
    {"name": "level__pct", "no_data": 0, "raster_table": {"rows": [{"value": k, "meaning": 10 * k} for k in range(1, 6)]}},
    {"name": "grade__code", "no_data": 0, "raster_table": {"rows": [{"value": 1, "meaning": 30}, {"value": 2, "meaning": 10}, {"value": 4, "meaning": 20}]}},
    {"name": "is__flag", "no_data": 0, "raster_table": {"rows": [{"value": 0, "meaning": "false"}, {"value": 1, "meaning": "true"}]}},
]
LINEITEM_ENVIRONMENT = [
    {"name": "quantity", "no_data": 0, "raster_table": {"rows": [{"value": k, "meaning": k} for k in range(1, 51)]}},
    {"name": "flag__type", "no_data": 0, "raster_table": {"rows": [{"value": 1, "meaning": "A"}, {"value": 2, "meaning": "N"}, {"value": 3, "meaning": "R"}]}},
    {"name": "discount__percent", "no_data": 0},
    {"name": "price", "no_data": "nan"},
    {"name": "ship__date", "no_data": 0, "decode_expression": "(A + 9130).astype('datetime64[D]').astype(str)", "encode_expression": "(datetime64(A) - 9130).astype(uint16)"},
]


def events_catalog() -> Catalog:
    return Catalog.of(EVENTS_ENVIRONMENT)


def lineitem_catalog() -> Catalog:
    return Catalog.of(LINEITEM_ENVIRONMENT)


def px_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel per event on the grid 10/40000, with all source layers."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    code = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("click", 1, "error", 2, "purchase", 3, "signup", 4)]), F.col("event_type")), F.lit(0))
    day = F.datediff(F.to_date("ts"), F.lit("2014-12-31").cast("date"))
    value = F.when(F.col("event_id") % 17 == 0, F.lit(math.nan)).otherwise(F.col("value"))
    return e.select(
        (16000 + F.floor(F.col("event_id") / 100) * 100).cast("long").alias("prow"),
        (40000 + F.col("event_id") % 100 * 100).cast("long").alias("pcol"),
        code.alias("event__type"),
        k.alias("class__k"),
        k.alias("percent__k"),
        k.alias("any__k"),
        (F.col("user_id") % 20 + 1).cast("int").alias("loss__year"),
        (day + 8192 * (2 + F.col("user_id") % 2)).cast("int").alias("alert__date_conf"),
        value.alias("value__per_ha"),
        (F.col("event_id") % 7).cast("int").alias("level__pct"),
        (F.col("event_id") % 5).cast("int").alias("grade__code"),
        (F.col("event_id") % 2).cast("int").alias("is__flag"),
    )


def px_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel per line item; pixels repeat, so it serves scans and aggregates, not joins."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "R", 3).otherwise(0)
    return t.select(
        (F.col("l_suppkey") * 50 + F.col("l_linenumber")).alias("prow"),
        (F.col("l_partkey") % 40000).alias("pcol"),
        F.col("l_quantity").cast("int").alias("quantity"),
        flag.alias("flag__type"),
        F.round(F.col("l_discount") * 100).cast("int").alias("discount__percent"),
        F.col("l_extendedprice").alias("price"),
        F.datediff(F.to_date("l_shipdate"), F.lit("1994-12-31").cast("date")).alias("ship__date"),
    )
