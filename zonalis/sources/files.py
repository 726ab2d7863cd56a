"""Reading layers by the catalogue: the Parquet files of the tiles under the geometries, and no others.

A layer's `uri` is a template with {tile_id}, its `tile_scheme` names the tile and its grid says how large a file is. A
file holds the pixels of its tile: (prow, pcol, <layer>). The tiles under the geometries follow from their scanline
intervals; there are as many as the grid has files at most (648 of 10 degrees, 64,800 of one degree), and their names are
the only thing that reaches the driver. A tile without a file is zeros inside the geometries, or nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryParseError
from ..operators.grids import Grid, file_name
from ..operators.masks import intervals
from ..plans.catalog import Layer

Tile = tuple[int, int]


def touched(features: DataFrame, grid: Grid) -> list[Tile]:
    """(file_y, file_x) of the files that hold a pixel inside one of the features (fid, geometry)."""
    file = lambda c: F.floor(c / grid.pixels).cast("long")
    lines = intervals(features, grid).select(file(F.col("prow")).alias("y"), file(F.col("c0")).alias("a"), file(F.col("c1") - 1).alias("b")).distinct()
    tiles = lines.select("y", F.explode(F.sequence("a", "b")).alias("x")).distinct()
    return sorted((r["y"], r["x"]) for r in tiles.collect())  # as many as the grid has files at most


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def pixels_inside(features: DataFrame, grid: Grid, tiles: list[Tile]) -> DataFrame:
    """(prow, pcol) of all pixels of some files that are inside one of the features, each once; made on the executors."""
    spark = features.sparkSession
    wanted = F.broadcast(spark.createDataFrame(tiles, "y long, x long"))  # as many as the grid has files at most
    lines = intervals(features, grid)
    size = F.lit(grid.pixels)
    at = (F.floor(F.col("prow") / size) == F.col("y")) & (F.col("c0") < (F.col("x") + 1) * size) & (F.col("c1") > F.col("x") * size)
    cut = lines.join(wanted, at).select("prow", F.greatest("c0", F.col("x") * size).alias("c0"), F.least("c1", (F.col("x") + 1) * size).alias("c1"))
    return cut.select("prow", F.explode(F.sequence("c0", F.col("c1") - 1)).alias("pcol")).distinct()


def read_layer(layer: Layer, features: DataFrame, tiles: list[Tile], missing: str = "zero") -> DataFrame:
    """(prow, pcol, <layer>) of the files that a layer has for the tiles; `missing` 'zero' makes zeros of the others' pixels."""
    if "{tile_id}" not in layer.uri:
        raise QueryParseError(f"layer {layer.name} needs a source_uri with {{tile_id}}")
    spark, grid = features.sparkSession, Grid.of(layer.grid)
    paths = {t: layer.uri.format(tile_id=file_name(*t, grid, layer.tile_scheme)) for t in tiles}
    here = {t: p for t, p in paths.items() if exists(spark, p)}
    out = spark.read.parquet(*here.values()).select("prow", "pcol", layer.name) if here else None
    away = [t for t in tiles if t not in here]
    if out is None or away and missing == "zero":
        kind = out.schema[layer.name].dataType if out is not None else "int"
        zeros = pixels_inside(features, grid, away).withColumn(layer.name, F.lit(0).cast(kind))
        out = out.unionByName(zeros) if out is not None else zeros if missing == "zero" else zeros.limit(0)
    return out
