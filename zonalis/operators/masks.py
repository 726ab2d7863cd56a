"""Polygon masks: GeoJSON to edges to scanline intervals to pixels, in Spark SQL only.

A pixel is inside where its centre is, by the even-odd rule within a polygon; polygons of one geometry are united, so
overlaps count once. Intervals are half open in columns.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidGeometryError
from .grids import TILE_PIXELS, Grid

#: Intervals up to which they may be broadcast: about 32 bytes each.
BROADCAST_INTERVALS = 200_000
RINGS = "array<array<array<array<double>>>>"


def distinct_shapes(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fid, _shape) of the features (fid, geometry), and a feature (_shape as fid, geometry) for each different text.

    Shapes are dealt out anew: few bytes become many scanlines, which AQE doesn't see, and dealt by shape they would stay so.
    """
    keyed = features.select("fid", "geometry", F.coalesce(F.sha2("geometry", 256), F.lit("")).alias("_shape"))
    shapes = keyed.groupBy("_shape").agg(F.min("geometry").alias("geometry")).withColumnRenamed("_shape", "fid")
    return keyed.select("fid", "_shape"), shapes.repartition(int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def polygons(features: DataFrame) -> DataFrame:
    """features (fid, geometry) with rings, an array of polygons of closed rings of points; null where the GeoJSON is unusable.

    A ring that doesn't end where it starts is closed; it needs three points, or four with the last on the first.
    """
    kind = F.get_json_object("geometry", "$.type")
    inner = F.get_json_object("geometry", "$.coordinates")
    text = F.when(kind == "Polygon", F.concat(F.lit("["), inner, F.lit("]"))).when(kind == "MultiPolygon", inner)
    rings = F.from_json(text, RINGS)
    points = lambda r: r.isNotNull() & (F.size(r) >= 3) & F.forall(r, lambda x: x.isNotNull() & (F.size(x) >= 2) & F.forall(x, lambda v: v.isNotNull()))
    sound = F.forall(rings, lambda p: p.isNotNull() & (F.size(p) > 0) & F.forall(p, points))
    first, last = lambda r: F.get(r, F.lit(0)), lambda r: F.get(r, F.size(r) - 1)
    closed = lambda r: F.when(F.slice(first(r), 1, 2) == F.slice(last(r), 1, 2), r).otherwise(F.concat(r, F.array(first(r))))
    whole = F.transform(rings, lambda p: F.transform(p, closed))
    enough = F.forall(whole, lambda p: F.forall(p, lambda r: F.size(r) >= 4))
    return features.withColumn("rings", F.when((F.size(rings) > 0) & sound, F.when(enough, whole)))


def boxes(features: DataFrame) -> DataFrame:
    """(fid, west, south, east, north) of the features (fid, geometry) that have usable rings."""
    point = F.flatten(F.flatten("rings"))
    span = lambda i: F.transform(point, lambda p: p[i])
    out = polygons(features).where("rings is not null")
    return out.select("fid", F.array_min(span(0)).alias("west"), F.array_min(span(1)).alias("south"), F.array_max(span(0)).alias("east"), F.array_max(span(1)).alias("north"))


def edges(features: DataFrame) -> DataFrame:
    """(fid, part, x0, y0, x1, y1), y0 < y1, of all edges that aren't horizontal."""
    part = polygons(features).select("fid", F.posexplode("rings").alias("part", "rings"))
    ring = part.select("fid", "part", F.explode("rings").alias("ring"))
    pair = ring.select("fid", "part", F.explode(F.arrays_zip(F.slice("ring", F.lit(1), F.size("ring") - 1).alias("a"), F.slice("ring", F.lit(2), F.size("ring") - 1).alias("b"))).alias("e"))
    a, b = F.col("e.a"), F.col("e.b")
    up = a[1] < b[1]
    take = lambda i, first: F.when(up if first else ~up, a[i]).otherwise(b[i])
    return pair.select("fid", "part", take(0, True).alias("x0"), take(1, True).alias("y0"), take(0, False).alias("x1"), take(1, False).alias("y1")).where("y0 < y1")


def intervals(features: DataFrame, grid: Grid) -> DataFrame:
    """(fid, prow, c0, c1): pixels c0 <= pcol < c1 of a row are inside; intervals of a row don't touch."""
    w = F.lit(grid.width)
    first, last = F.ceil(F.col("y0") / w - 0.5).cast("long"), (F.ceil(F.col("y1") / w - 0.5) - 1).cast("long")
    rows = edges(features).withColumn("r0", first).withColumn("r1", last).where("r0 <= r1")
    rows = rows.select("fid", "part", "x0", "y0", "x1", "y1", F.explode(F.sequence("r0", "r1")).alias("prow"))
    x = F.col("x0") + ((F.col("prow") + 0.5) * w - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    cross = rows.groupBy("fid", "part", "prow").agg(F.sort_array(F.collect_list(F.ceil(x / w - 0.5).cast("long"))).alias("xs"))
    half = (F.size("xs") / 2).cast("int")
    pair = F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.struct(F.get(F.col("xs"), 2 * i).alias("c0"), F.get(F.col("xs"), 2 * i + 1).alias("c1")))
    found = cross.where("size(xs) >= 2").select("fid", "prow", F.explode(pair).alias("p")).select("fid", "prow", "p.c0", "p.c1").where("c0 < c1")
    by = Window.partitionBy("fid", "prow").orderBy("c0", "c1")  # the intervals of one pixel row
    before = F.max("c1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("before").isNull() | (F.col("c0") > F.col("before")), 1).otherwise(0)).over(by)
    runs = found.withColumn("before", before).withColumn("island", island)
    return runs.groupBy("fid", "prow", "island").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("island")


@dataclass(frozen=True)
class Shape:
    """What the driver knows of one geometry."""

    text: str
    west: float
    south: float
    east: float
    north: float
    box: bool
    rows: float  # pixel rows times crossings, in degrees

    @classmethod
    def of(cls, geometry: dict | str) -> Shape:
        g = json.loads(geometry) if isinstance(geometry, str) else geometry
        try:
            parts = [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"] if g["type"] == "MultiPolygon" else None
            rings = [[(float(p[0]), float(p[1])) for p in ring] for part in parts for ring in part]
            rings = [r if r and r[0] == r[-1] else r + r[:1] for r in rings]
            if not rings or min(len(r) for r in rings) < 4:
                raise ValueError("a ring needs three points, or four with the last on the first")
        except (KeyError, TypeError, ValueError, IndexError) as e:
            raise InvalidGeometryError("the geometry must be a Polygon or MultiPolygon") from e
        xs, ys = [x for r in rings for x, _ in r], [y for r in rings for _, y in r]
        west, south, east, north = min(xs), min(ys), max(xs), max(ys)
        corners = {(west, south), (west, north), (east, south), (east, north)}
        square = len(rings) == 1 and len(rings[0]) == 5 and set(rings[0]) == corners and all(a[0] == b[0] or a[1] == b[1] for a, b in zip(rings[0], rings[0][1:], strict=False))
        high = sum(abs(b[1] - a[1]) for r in rings for a, b in zip(r, r[1:], strict=False))
        return cls(json.dumps(g), west, south, east, north, square, high)


def mask(pixels: DataFrame, shape: Shape, grid: Grid) -> DataFrame:
    """The pixels (prow, pcol, ...) whose centres are inside one geometry.

    The bounding box is pushed to the scan; a box needs no more. Intervals are broadcast below a checked number of them,
    else joined by row.
    """
    spark, w = pixels.sparkSession, F.lit(grid.width)
    edge = lambda v: F.ceil(F.lit(v) / w - 0.5).cast("long")
    inside = pixels.where((F.col("prow") >= edge(shape.south)) & (F.col("prow") < edge(shape.north)) & (F.col("pcol") >= edge(shape.west)) & (F.col("pcol") < edge(shape.east)))
    if shape.box:
        return inside
    lines = intervals(spark.createDataFrame([(0, shape.text)], "fid int, geometry string"), grid).drop("fid")
    if shape.rows / grid.width / 2 <= BROADCAST_INTERVALS:
        lines = F.broadcast(lines)
    lines = lines.withColumnRenamed("prow", "_row")
    joined = inside.join(lines, (F.col("prow") == F.col("_row")) & (F.col("pcol") >= F.col("c0")) & (F.col("pcol") < F.col("c1")))
    return joined.drop("_row", "c0", "c1")


def mask_features(pixels: DataFrame, features: DataFrame, grid: Grid) -> DataFrame:
    """The pixels inside each feature (fid, geometry), with fid.

    The box around all features, a scalar subquery, reaches the scan. Intervals are cut at tile columns and joined by pixel
    row and tile column, so a pixel meets the intervals of its own tile only; AQE may split or broadcast the join.
    """
    around = boxes(features).agg(*(f(c).alias(c) for f, c in ((F.min, "west"), (F.min, "south"), (F.max, "east"), (F.max, "north"))))
    edge = lambda c, more: (F.floor(F.col(c) / F.lit(grid.width)) + more).cast("long").alias(c)  # noqa: E731  one pixel to spare
    least = around.select(edge("west", -1), edge("south", -1), edge("east", 1), edge("north", 1))
    bound = {c: least.select(c).scalar() for c in least.columns}
    near = pixels.where((F.col("prow") >= bound["south"]) & (F.col("prow") <= bound["north"]) & (F.col("pcol") >= bound["west"]) & (F.col("pcol") <= bound["east"]))
    lines = intervals(features, grid).withColumn("_tile", F.explode(F.sequence(grid.tile(F.col("c0")), grid.tile(F.col("c1") - 1))))
    first = F.col("_tile") * TILE_PIXELS
    lines = lines.select("fid", F.col("prow").alias("_row"), "_tile", F.greatest("c0", first).alias("c0"), F.least("c1", first + TILE_PIXELS).alias("c1"))
    at = (F.col("prow") == F.col("_row")) & (grid.tile(F.col("pcol")) == F.col("_tile"))
    joined = near.join(lines, at & (F.col("pcol") >= F.col("c0")) & (F.col("pcol") < F.col("c1")))
    return joined.drop("_row", "_tile", "c0", "c1")
