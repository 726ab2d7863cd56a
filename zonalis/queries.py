"""The engine's registered queries and, for each, independent SQL over the same tables.

The SQL masks polygons by ray casting over an edge list, not by scanlines, and decodes by CASE.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.batch import batch_status, envelopes, feature_status
from .operators.cube import clean, from_blocks, to_blocks
from .operators.grids import Grid, tile_cover, tile_id_nw, tile_id_nwse
from .operators.masks import boxes
from .plans.engine import Engine
from .sources.pixels import events_catalog, lineitem_catalog, px_events, px_lineitem

Query = Callable[[SparkSession, str], DataFrame]
GRID = Grid.of("10/40000")


def _ring(*points: tuple[float, float]) -> list[list[float]]:
    return [list(p) for p in (*points, points[0])]


def _box(west: float, south: float, east: float, north: float) -> list[list[float]]:
    return _ring((west, south), (east, south), (east, north), (west, north))


#: Boxes that mean everything reach far beyond the pole: the synthetic rows grow with the tables.
SHAPES: dict[str, dict] = {
    "box_all": {"type": "Polygon", "coordinates": [_box(9.9, 3.9, 12.6, 3e6)]},
    "box_half": {"type": "Polygon", "coordinates": [_box(10.5, 3.9, 12.6, 3e6)]},
    "triangle": {"type": "Polygon", "coordinates": [_ring((10, 4), (12.5, 4), (11.2, 6.5))]},
    "donut": {"type": "Polygon", "coordinates": [_box(10, 4, 12.5, 6.5), _box(11, 5, 11.5, 5.5)]},
    "multi": {"type": "MultiPolygon", "coordinates": [[_box(10, 4, 10.7, 5.1)], [_box(11.3, 4.9, 12.2, 6.2)]]},
    "concave": {"type": "Polygon", "coordinates": [_ring((10, 4), (12.4, 4), (12.4, 4.8), (11, 4.8), (11, 6.4), (10, 6.4))]},
    "outside": {"type": "Polygon", "coordinates": [_box(0, 40, 1, 41)]},
    "open_ring": {"type": "Polygon", "coordinates": [[[10, 4], [12.5, 4], [11.2, 6.5]]]},
    "world": {"type": "Polygon", "coordinates": [_box(-180, -80, 180, 3e6)]},
}
LON, LAT = "((pcol + 0.5) * 0.00025)", "((prow + 0.5) * 0.00025)"
#: A pixel's hectares by the midpoint rule on the ellipsoid's surface element, at the centre of its row of tiles.
_MID = "radians((floor(prow / 5000.0) + 0.5) * 1.25 + 0.000125)"
AREA = f"(pow(6356752.314245179, 2) * cos({_MID}) / pow(1 - (1 - pow(6356752.314245179 / 6378137.0, 2)) * pow(sin({_MID}), 2), 2) * pow(radians(0.00025), 2) / 10000)"
PX = """px AS (SELECT 16000 + (event_id // 100) * 100 AS prow, 40000 + (event_id % 100) * 100 AS pcol,
 CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 0 END AS et,
 CAST(json_extract(props, '$.k') AS INT) AS k, user_id % 20 + 1 AS ly, date_diff('day', DATE '2014-12-31', CAST(ts AS DATE)) AS d,
 2 + user_id % 2 AS conf, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS v, event_id % 2 AS flag, event_id % 7 AS lv, event_id % 5 AS gr FROM events)"""
LX = """px AS (SELECT l_suppkey * 50 + l_linenumber AS prow, l_partkey % 40000 AS pcol, CAST(l_quantity AS INT) AS q,
 CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 ELSE 0 END AS rf, CAST(round(l_discount * 100) AS INT) AS disc,
 l_extendedprice AS price, date_diff('day', DATE '1994-12-31', CAST(l_shipdate AS DATE)) AS sd FROM lineitem)"""
CLASS = "CASE WHEN k BETWEEN 1 AND 29 THEN 'Low' WHEN k BETWEEN 30 AND 59 THEN 'Mid' WHEN k BETWEEN 60 AND 98 THEN 'High' ELSE 'Unknown' END"
DATE = "CAST(DATE '2014-12-31' + CAST(d AS INT) AS VARCHAR)"
TYPE = "CASE et WHEN 1 THEN 'click' WHEN 2 THEN 'error' WHEN 3 THEN 'purchase' WHEN 4 THEN 'signup' END"


def _inside(shape: str) -> str:
    """Ray casting over the edges of all rings."""
    g = SHAPES[shape]
    parts = [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"]
    edges = [(*a, *b) for part in parts for ring in part for a, b in zip(ring, [*ring[1:], ring[0]], strict=True) if a[1] != b[1]]
    rays = " + ".join(f"(CASE WHEN ({y0} <= {LAT}) <> ({y1} <= {LAT}) AND {LON} < {x0} + ({LAT} - {y0}) * ({x1} - {x0}) / ({y1} - ({y0})) THEN 1 ELSE 0 END)" for x0, y0, x1, y1 in ((float(v) for v in e) for e in edges))
    return f"(({rays}) % 2 = 1)"


#: name: (raster SQL, shape, rounding of result columns, the select list and the rest in SQL)
SPECS: dict[str, tuple[str, str, dict[str, int], str, str]] = {
    "zonal_count_all": ("SELECT COUNT(*) FROM data", "box_all", {}, "count(*) AS count", ""),
    "zonal_sum_area": ("SELECT SUM(area__ha) FROM data", "box_all", {"area__ha": 3}, f"round(sum({AREA}), 3) AS area__ha", ""),
    "zonal_avg_area": ("SELECT AVG(area__ha) FROM data", "triangle", {"area__ha": 8}, f"round(avg({AREA}), 8) AS area__ha", ""),
    "zonal_sum_layer": ("SELECT SUM(value__per_ha) FROM data", "box_all", {"value__per_ha": 2}, "round(sum(v), 2) AS value__per_ha", ""),
    "zonal_avg_layer": ("SELECT AVG(value__per_ha) AS mean FROM data", "box_half", {"mean": 4}, "round(avg(v), 4) AS mean", ""),
    "zonal_sum_and_avg": ("SELECT SUM(value__per_ha) AS total, AVG(value__per_ha) AS mean, COUNT(*) AS n FROM data", "triangle", {"total": 2, "mean": 4}, "round(sum(v), 2) AS total, round(avg(v), 4) AS mean, count(*) AS n", ""),
    "zonal_empty": ("SELECT COUNT(*), SUM(area__ha) FROM event__type", "outside", {}, "count(*) AS count, coalesce(sum(et), 0.0) AS area__ha", ""),
    "count_any_argument": ("SELECT COUNT(no_such_layer) FROM event__type", "box_all", {}, "count(*) AS count", "AND et <> 0"),
    "base_nodata_mask": ("SELECT COUNT(*) FROM event__type", "box_all", {}, "count(*) AS count", "AND et <> 0"),
    "base_nodata_nan": ("SELECT COUNT(*) FROM value__per_ha", "box_all", {}, "count(*) AS count", "AND v IS NOT NULL"),
    "nodata_nonzero": ("SELECT COUNT(*) FROM percent__k", "box_all", {}, "count(*) AS count", "AND k <> 99"),
    "nodata_nonzero_group": ("SELECT percent__k, COUNT(*) FROM data GROUP BY percent__k", "box_all", {}, "k AS percent__k, count(*) AS count", "AND k <> 99 GROUP BY k"),
    "nodata_null": ("SELECT any__k, COUNT(*) FROM any__k GROUP BY any__k", "box_all", {}, "k AS any__k, count(*) AS count", "GROUP BY k"),
    "nodata_summed": ("SELECT SUM(percent__k) FROM data", "box_all", {}, "CAST(sum(k) AS DOUBLE) AS percent__k", ""),
    "filter_and": ("SELECT COUNT(*) FROM data WHERE loss__year >= 2010 AND is__flag = 'true'", "box_all", {}, "count(*) AS count", "AND ly >= 10 AND flag = 1"),
    "filter_or": ("SELECT COUNT(*) FROM data WHERE loss__year < 2005 OR class__k = 'High'", "box_all", {}, "count(*) AS count", "AND (ly < 5 OR k BETWEEN 60 AND 98)"),
    "filter_nested": ("SELECT COUNT(*) FROM event__type WHERE is__flag = 'true' AND (loss__year = 2003 OR (value__per_ha > 50 AND loss__year > 2010))", "triangle", {}, "count(*) AS count", "AND et <> 0 AND flag = 1 AND (ly = 3 OR (v > 50 AND ly > 10))"),
    "filter_or_of_and": ("SELECT COUNT(*) FROM data WHERE loss__year = 2001 OR (class__k = 'Mid' AND event__type = 'click')", "box_all", {}, "count(*) AS count", "AND (ly = 1 OR (k BETWEEN 30 AND 59 AND et = 1))"),
    "filter_encoded_eq": ("SELECT COUNT(*) FROM data WHERE event__type = 'purchase'", "box_all", {}, "count(*) AS count", "AND et = 3"),
    "filter_encoded_neq": ("SELECT COUNT(*) FROM data WHERE class__k != 'Mid'", "box_all", {}, "count(*) AS count", "AND k NOT BETWEEN 30 AND 59"),
    "filter_neq_unlisted": ("SELECT COUNT(*) FROM data WHERE event__type != 'click' AND level__pct != 20", "box_all", {}, "count(*) AS count", "AND et <> 1 AND lv <> 2"),
    "filter_lt_unlisted": ("SELECT COUNT(*) FROM data WHERE level__pct < 30", "box_all", {}, "count(*) AS count", "AND lv < 3"),
    "filter_gte_unlisted": ("SELECT level__pct, COUNT(*) FROM data WHERE level__pct >= 40 OR level__pct <= 10 GROUP BY level__pct", "box_all", {}, "lv * 10 AS level__pct, count(*) AS count", "AND (lv >= 4 OR lv <= 1) AND lv BETWEEN 1 AND 5 GROUP BY lv"),
    "filter_order_not_rising": ("SELECT COUNT(*) FROM data WHERE grade__code >= 20", "box_all", {}, "count(*) AS count", "AND gr IN (1, 4)"),
    "polygon_open_ring": ("SELECT COUNT(*), SUM(area__ha) FROM data", "open_ring", {"area__ha": 4}, f"count(*) AS count, round(sum({AREA}), 4) AS area__ha", ""),
    "filter_encoded_gte": ("SELECT COUNT(*) FROM data WHERE loss__year >= 2015 AND loss__year <= 2018", "box_all", {}, "count(*) AS count", "AND ly BETWEEN 15 AND 18"),
    "filter_default_meaning": ("SELECT COUNT(*) FROM data WHERE class__k = 'Unknown'", "box_all", {}, "count(*) AS count", "AND k IN (0, 99)"),
    "filter_float_nan": ("SELECT COUNT(*) FROM data WHERE value__per_ha != 0 AND is__flag = 'false'", "box_all", {}, "count(*) AS count", "AND (v IS NULL OR v <> 0) AND flag = 0"),
    "filter_date": ("SELECT COUNT(*) FROM data WHERE alert__date >= '2024-01-10' AND alert__date < '2024-01-20'", "box_all", {}, "count(*) AS count", "AND d >= date_diff('day', DATE '2014-12-31', DATE '2024-01-10') AND d < date_diff('day', DATE '2014-12-31', DATE '2024-01-20')"),
    "filter_coordinates": ("SELECT COUNT(*) FROM data WHERE latitude > 4.5 AND longitude <= 11.5", "box_all", {}, "count(*) AS count", f"AND {LAT} > 4.5 AND {LON} <= 11.5"),
    "group_one": ("SELECT loss__year, COUNT(*), SUM(area__ha) FROM event__type GROUP BY loss__year", "box_half", {"area__ha": 4}, f"ly + 2000 AS loss__year, count(*) AS count, round(sum({AREA}), 4) AS area__ha", "AND et <> 0 GROUP BY ly"),
    "group_two": ("SELECT loss__year, event__type, COUNT(*) FROM data GROUP BY loss__year, event__type", "triangle", {}, f"ly + 2000 AS loss__year, {TYPE} AS event__type, count(*) AS count", "AND et <> 0 GROUP BY ly, et"),
    "group_default_meaning": ("SELECT class__k, SUM(area__ha) FROM data GROUP BY class__k", "donut", {"area__ha": 4}, f"{CLASS} AS class__k, round(sum({AREA}), 4) AS area__ha", "GROUP BY 1"),
    "group_nodata_excluded": ("SELECT COUNT(*) FROM data GROUP BY event__type", "box_all", {}, f"{TYPE} AS event__type, count(*) AS count", "AND et <> 0 GROUP BY et"),
    "group_zero_meaning": ("SELECT is__flag, COUNT(*) FROM data GROUP BY is__flag", "concave", {}, "CASE flag WHEN 1 THEN 'true' ELSE 'false' END AS is__flag, count(*) AS count", "GROUP BY flag"),
    "group_many_to_one": ("SELECT class__k AS kind, COUNT(*), AVG(value__per_ha) AS mean FROM event__type GROUP BY class__k", "box_all", {"mean": 4}, f"{CLASS} AS kind, count(*) AS count, round(avg(v), 4) AS mean", "AND et <> 0 GROUP BY 1"),
    "group_avg": ("SELECT loss__year, AVG(value__per_ha) FROM data GROUP BY loss__year", "box_all", {"value__per_ha": 4}, "ly + 2000 AS loss__year, round(avg(v), 4) AS value__per_ha", "GROUP BY ly"),
    "group_isoweek": ("SELECT isoweek(alert__date), COUNT(*) FROM data WHERE alert__confidence = 'high' GROUP BY isoweek(alert__date)", "box_all", {}, "isoyear(DATE '2014-12-31' + CAST(d AS INT)) AS alert__year, week(DATE '2014-12-31' + CAST(d AS INT)) AS alert__isoweek, count(*) AS count", "AND conf = 3 GROUP BY 1, 2"),
    "select_isoweek": ("SELECT latitude, longitude, isoweek(alert__date) AS wk FROM event__type WHERE loss__year = 2002", "triangle", {"latitude": 6, "longitude": 6}, f"round({LAT}, 6) AS latitude, round({LON}, 6) AS longitude, isoyear(DATE '2014-12-31' + CAST(d AS INT)) AS alert__year, week(DATE '2014-12-31' + CAST(d AS INT)) AS wk", "AND et <> 0 AND ly = 2"),
    "derived_date": ("SELECT alert__date, COUNT(*) FROM data GROUP BY alert__date", "box_all", {}, f"{DATE} AS alert__date, count(*) AS count", "GROUP BY d"),
    "derived_confidence": ("SELECT alert__confidence, COUNT(*) FROM data GROUP BY alert__confidence", "box_all", {}, "CASE conf WHEN 3 THEN 'high' ELSE '' END AS alert__confidence, count(*) AS count", "GROUP BY conf"),
    "derived_times_area": ("SELECT loss__year, SUM(value__total) FROM event__type GROUP BY loss__year", "box_all", {"value__total": 2}, f"ly + 2000 AS loss__year, round(coalesce(sum(v * {AREA}), 0), 2) AS value__total", "AND et <> 0 GROUP BY ly"),
    "auto_area_layer": ("SELECT loss__year, SUM(event__ha), SUM(flag__ha) AS f FROM data GROUP BY loss__year", "box_all", {"event__ha": 4, "f": 4}, f"ly + 2000 AS loss__year, round(sum(CASE WHEN et > 0 THEN {AREA} ELSE 0 END), 4) AS event__ha, round(sum(CASE WHEN flag > 0 THEN {AREA} ELSE 0 END), 4) AS f", "GROUP BY ly"),
    "select_rows": ("SELECT class__k, loss__year, value__per_ha FROM event__type WHERE loss__year <= 2002", "donut", {}, f"{CLASS} AS class__k, CAST(ly + 2000 AS INT) AS loss__year, v AS value__per_ha", "AND et <> 0 AND ly <= 2"),
    "select_lat_lon": ("SELECT latitude, longitude, alert__date FROM event__type WHERE alert__date > '2024-01-25'", "triangle", {"latitude": 6, "longitude": 6}, f"round({LAT}, 6) AS latitude, round({LON}, 6) AS longitude, {DATE} AS alert__date", "AND et <> 0 AND d > date_diff('day', DATE '2014-12-31', DATE '2024-01-25')"),
    "order_limit": ("SELECT alert__date, latitude, longitude FROM event__type ORDER BY alert__date DESC, latitude, longitude LIMIT 50", "box_all", {"latitude": 6, "longitude": 6}, f"{DATE} AS alert__date, round({LAT}, 6) AS latitude, round({LON}, 6) AS longitude", "AND et <> 0 ORDER BY d DESC, prow, pcol LIMIT 50"),
    "alias": ("SELECT event__type AS kind, COUNT(*) AS n, SUM(area__ha) AS ha FROM data GROUP BY event__type ORDER BY n DESC", "box_all", {"ha": 4}, f"{TYPE} AS kind, count(*) AS n, round(sum({AREA}), 4) AS ha", "AND et <> 0 GROUP BY et"),
    "polygon_mask": ("SELECT COUNT(*), SUM(area__ha) FROM data", "triangle", {"area__ha": 4}, f"count(*) AS count, round(sum({AREA}), 4) AS area__ha", ""),
    "polygon_with_hole": ("SELECT COUNT(*) FROM data", "donut", {}, "count(*) AS count", ""),
    "polygon_concave": ("SELECT COUNT(*) FROM data", "concave", {}, "count(*) AS count", ""),
    "multipolygon_mask": ("SELECT loss__year, COUNT(*) FROM data GROUP BY loss__year", "multi", {}, "ly + 2000 AS loss__year, count(*) AS count", "GROUP BY ly"),
}
LINE_SPECS: dict[str, tuple[str, str, dict[str, int], str, str]] = {
    "lineitem_zonal_group": ("SELECT quantity, COUNT(*), SUM(price) AS price, AVG(price) AS mean FROM discount__percent WHERE flag__type != 'N' GROUP BY quantity", "world", {"price": 0, "mean": 2}, "q AS quantity, count(*) AS count, round(sum(price), 0) AS price, round(avg(price), 2) AS mean", "AND disc <> 0 AND rf <> 2 GROUP BY q"),
    "lineitem_ship_week": ("SELECT isoweek(ship__date), COUNT(*), SUM(area__ha) FROM data WHERE flag__type = 'R' GROUP BY isoweek(ship__date)", "world", {"area__ha": 4}, f"isoyear(DATE '1994-12-31' + CAST(sd AS INT)) AS ship__year, week(DATE '1994-12-31' + CAST(sd AS INT)) AS ship__isoweek, count(*) AS count, round(sum({AREA}), 4) AS area__ha", "AND rf = 3 AND sd <> 0 GROUP BY 1, 2"),
    "lineitem_filtered_area": ("SELECT flag__type, SUM(area__ha) FROM quantity WHERE quantity >= 25 AND discount__percent <= 5 GROUP BY flag__type", "world", {"area__ha": 4}, f"CASE rf WHEN 1 THEN 'A' WHEN 2 THEN 'N' ELSE 'R' END AS flag__type, round(sum({AREA}), 4) AS area__ha", "AND q >= 25 AND disc <= 5 AND rf <> 0 GROUP BY rf"),
}


def _run(text: str, shape: str, digits: dict[str, int], line: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pixels = px_lineitem(spark, sf_dir) if line else px_events(spark, sf_dir)
        out = Engine(spark, lineitem_catalog() if line else events_catalog(), pixels).sql(text, SHAPES[shape])
        return out.withColumns({c: F.round(c, n) for c, n in digits.items()})

    return query


def split_layers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three layer tables of px_events: types without NoData rows, classes, and values without tile (tile_y 3, tile_x 8)."""
    px = px_events(spark, sf_dir)
    tile = lambda c: F.floor(F.col(c) / 5000)
    return {
        "event__type": px.where("event__type <> 0").select("prow", "pcol", "event__type"),
        "class__k": px.select("prow", "pcol", "class__k"),
        "value__per_ha": clean(px, ["value__per_ha"]).where((tile("prow") != 3) | (tile("pcol") != 8)).select("prow", "pcol", "value__per_ha"),
    }


def multi_layer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Engine(spark, events_catalog(), split_layers(spark, sf_dir)).sql("SELECT class__k, COUNT(*), SUM(value__per_ha) AS total, AVG(value__per_ha) AS mean FROM event__type GROUP BY class__k", SHAPES["box_all"])
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


def missing_tile(missing: str) -> Query:
    """A layer without data in one tile, which is 0 there by default, and null with 'nodata'."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, events_catalog(), split_layers(spark, sf_dir), missing=missing)
        return engine.sql("SELECT class__k, COUNT(*), AVG(value__per_ha) AS mean FROM data WHERE value__per_ha < 50 OR event__type = 'click' GROUP BY class__k", SHAPES["box_all"]).withColumn("mean", F.round("mean", 4))

    return query


def block_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = px_events(spark, sf_dir)
    dense = from_blocks(to_blocks(px, ["event__type", "loss__year"], 1000), 1000)
    out = Engine(spark, events_catalog(), dense).sql("SELECT loss__year, COUNT(*), SUM(area__ha) FROM event__type GROUP BY loss__year", SHAPES["triangle"])
    return out.withColumn("area__ha", F.round("area__ha", 4))


def _features(spark: SparkSession) -> DataFrame:
    rows = [(n, json.dumps(SHAPES[n])) for n in ("triangle", "donut", "multi", "outside", "open_ring")] + [("broken", '{"type": "Polygon"'), ("point", '{"type": "Point", "coordinates": [10, 4]}')]
    return spark.createDataFrame(rows, "fid string, geometry string")


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature per customer: of five, two boxes, one open triangle, one point and one ring of two points."""
    w, s = F.lit(9.5) + F.col("c_custkey") % 30 * 0.1, F.lit(4.0) + F.col("c_custkey") % 20 * 0.1
    p = lambda x, y: F.format_string("[%.4f, %.4f]", x, y)
    ring = lambda *points: F.concat(F.lit('{"type": "Polygon", "coordinates": [['), F.concat_ws(", ", *points), F.lit("]]}"))
    box = ring(p(w, s), p(w + 0.5, s), p(w + 0.5, s + 0.5), p(w, s + 0.5), p(w, s))
    kind = F.col("c_custkey") % 5
    shape = F.when(kind < 2, box).when(kind == 2, ring(p(w, s), p(w + 0.5, s), p(w, s + 0.5))).when(kind == 3, F.concat(F.lit('{"type": "Point", "coordinates": '), p(w, s), F.lit("}"))).otherwise(ring(p(w, s), p(w + 0.5, s)))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("fid"), shape.alias("geometry"))


def _many(text: str, digits: dict[str, int]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Engine(spark, events_catalog(), px_events(spark, sf_dir)).sql_many(text, _features(spark))
        return out.withColumns({c: F.round(c, n) for c, n in digits.items()})

    return query


def batch_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, events_catalog(), px_events(spark, sf_dir)).sql_many("SELECT COUNT(*) FROM event__type", customer_features(spark, sf_dir))


def batch_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, events_catalog(), px_events(spark, sf_dir))
    out = envelopes(engine, "SELECT loss__year, COUNT(*) AS n FROM event__type GROUP BY loss__year ORDER BY n DESC, loss__year LIMIT 2", customer_features(spark, sf_dir))
    top = F.get_json_object("data", "$[0].n").cast("long")
    return out.select("fid", "status", F.col("message").isNotNull().alias("told"), F.json_array_length("data").cast("long").alias("n_rows"), top.alias("top"))


def batch_feature_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_status(customer_features(spark, sf_dir)).select("fid", "status")


def batch_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_status(feature_status(customer_features(spark, sf_dir)))


def tile_cover_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_cover(boxes(customer_features(spark, sf_dir)), GRID)


def tile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(event_id % 360 as double) - 179.5 lon", "cast(event_id % 160 as double) - 79.5 lat").distinct()
    return points.select("lon", "lat", tile_id_nw(F.col("lon"), F.col("lat"), GRID).alias("nw"), tile_id_nwse(F.col("lon"), F.col("lat"), GRID).alias("nwse"))


OTHER: dict[str, Query] = {
    "multi_layer_join": multi_layer_join, "missing_tile_zero": missing_tile("zero"), "missing_tile_nodata": missing_tile("nodata"), "block_mode": block_mode,
    "batch_features": _many("SELECT event__type, COUNT(*), SUM(area__ha) FROM event__type GROUP BY event__type", {"area__ha": 4}),
    "batch_zero_rows": _many("SELECT COUNT(*), SUM(area__ha), AVG(value__per_ha) AS mean FROM data", {"area__ha": 4, "mean": 4}),
    "batch_limit": _many("SELECT loss__year, COUNT(*) AS n FROM data GROUP BY loss__year ORDER BY n DESC, loss__year LIMIT 3", {}),
    "batch_customers": batch_customers, "batch_envelopes": batch_envelopes, "batch_feature_status": batch_feature_status, "batch_overall": batch_overall,
    "tile_cover": tile_cover_query, "tile_names": tile_names,
}


def _sql(shape: str, select: str, rest: str, line: bool) -> str:
    return f"WITH {LX if line else PX} SELECT {select} FROM px WHERE {_inside(shape)} {rest}"


def _name_sql(value: str, digits: int, plus: str, minus: str) -> str:
    return f"(lpad(CAST(abs({value}) AS VARCHAR), {digits}, '0') || CASE WHEN {value} >= 0 THEN '{plus}' ELSE '{minus}' END)"


def _other_sql() -> dict[str, str]:
    north, west = "CAST(ceil(lat / 10) * 10 AS INT)", "CAST(floor(lon / 10) * 10 AS INT)"
    lat = lambda v: _name_sql(v, 2, "N", "S")
    lon = lambda v: _name_sql(v, 3, "E", "W")
    far = "(floor(prow / 5000.0) <> 3 OR floor(pcol / 5000.0) <> 8)"
    names = ("triangle", "donut", "multi", "outside", "open_ring")
    many = lambda select, rest: f"WITH {PX} " + " UNION ALL ".join(f"SELECT '{n}' AS fid, {select} FROM px WHERE {_inside(n)} {rest}" for n in names)
    # a missing tile: no value there, which counts as 0; elsewhere a null value is no data
    split = f"{PX}, s AS (SELECT *, CASE WHEN {far} THEN v ELSE 0 END AS v0, CASE WHEN {far} THEN v END AS vn FROM px)"
    customers = "c AS (SELECT CAST(c_custkey AS VARCHAR) AS fid, c_custkey % 5 AS kind, 9.5 + c_custkey % 30 * 0.1 AS w, 4.0 + c_custkey % 20 * 0.1 AS s FROM customer)"
    # centres inside a customer's box, or below the diagonal of its triangle
    within = f"{LON} >= w AND {LON} < w + 0.5 AND {LAT} >= s AND {LAT} < s + 0.5 AND (kind < 2 OR {LON} - w < 0.5 - ({LAT} - s))"
    hits = f"{PX}, {customers}, h AS (SELECT fid, ly FROM c JOIN px ON {within} WHERE kind < 3 AND et <> 0)"
    missing = lambda v: f"WITH {split} SELECT {CLASS} AS class__k, count(*) AS count, round(avg({v}), 4) AS mean FROM s WHERE {_inside('box_all')} AND ({v} < 50 OR et = 1) GROUP BY 1"
    return {
        "multi_layer_join": f"WITH {split} SELECT {CLASS} AS class__k, count(*) AS count, round(coalesce(sum(v0), 0), 2) AS total, round(avg(v0), 4) AS mean FROM s WHERE {_inside('box_all')} AND et <> 0 GROUP BY 1",
        "missing_tile_zero": missing("v0"),
        "missing_tile_nodata": missing("vn"),
        "block_mode": _sql("triangle", f"ly + 2000 AS loss__year, count(*) AS count, round(sum({AREA}), 4) AS area__ha", "AND et <> 0 GROUP BY ly", False),
        "batch_features": many(f"{TYPE} AS event__type, count(*) AS count, round(sum({AREA}), 4) AS area__ha", "AND et <> 0 GROUP BY et"),
        "batch_zero_rows": many(f"count(*) AS count, round(coalesce(sum({AREA}), 0), 4) AS area__ha, round(avg(v), 4) AS mean", ""),
        "batch_limit": f"WITH m AS ({many('ly + 2000 AS loss__year, count(*) AS n', 'GROUP BY ly')}) SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY fid ORDER BY n DESC, loss__year) <= 3",
        "batch_customers": f"WITH {hits} SELECT c.fid, count(h.fid) AS count FROM c LEFT JOIN h ON c.fid = h.fid WHERE kind < 3 GROUP BY c.fid",
        "batch_envelopes": f"WITH {hits}, g AS (SELECT fid, ly, count(*) AS n FROM h GROUP BY fid, ly), e AS (SELECT fid, least(count(*), 2) AS n_rows, max(n) AS top FROM g GROUP BY fid) SELECT c.fid, CASE WHEN kind < 3 THEN 'success' ELSE 'failed' END AS status, kind >= 3 AS told, CASE WHEN kind < 3 THEN coalesce(n_rows, 0) END AS n_rows, top FROM c LEFT JOIN e ON c.fid = e.fid",
        "batch_feature_status": f"WITH {customers} SELECT fid, CASE WHEN kind < 3 THEN 'success' ELSE 'failed' END AS status FROM c",
        "batch_overall": f"WITH {customers} SELECT CASE WHEN bool_and(kind < 3) THEN 'success' WHEN bool_or(kind < 3) THEN 'partial_success' ELSE 'failed' END AS status, count(*) FILTER (WHERE kind < 3) AS succeeded, count(*) FILTER (WHERE kind >= 3) AS failed FROM c",
        "tile_cover": f"WITH {customers} SELECT fid, tile_x, tile_y FROM c, generate_series(0, 20) AS x(tile_x), generate_series(0, 20) AS y(tile_y) WHERE kind < 3 AND tile_x * 1.25 < w + 0.5 AND (tile_x + 1) * 1.25 > w AND tile_y * 1.25 < s + 0.5 AND (tile_y + 1) * 1.25 > s",
        "tile_names": f"WITH p AS (SELECT DISTINCT CAST(event_id % 360 AS DOUBLE) - 179.5 AS lon, CAST(event_id % 160 AS DOUBLE) - 79.5 AS lat FROM events) SELECT lon, lat, {lat(north)} || '_' || {lon(west)} AS nw, {lon(west)} || '_' || {lat(f'({north} - 10)')} || '_' || {lon(f'({west} + 10)')} || '_' || {lat(north)} AS nwse FROM p",
    }


QUERIES: dict[str, Query] = {
    **{name: _run(text, shape, digits, False) for name, (text, shape, digits, _, _) in SPECS.items()},
    **{name: _run(text, shape, digits, True) for name, (text, shape, digits, _, _) in LINE_SPECS.items()},
    **OTHER,
}
ORACLE_SQL: dict[str, str] = {
    **{name: _sql(shape, select, rest, False) for name, (_, shape, _, select, rest) in SPECS.items()},
    **{name: _sql(shape, select, rest, True) for name, (_, shape, _, select, rest) in LINE_SPECS.items()},
    **_other_sql(),
}
