"""Co-registration of layer tables, dense blocks, and fill of missing tiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grids import TILE_PIXELS

KEY = ["prow", "pcol"]


def clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN as null in float columns: Spark's NaN is greater than all numbers and equals itself."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast(kinds[c])) for c in columns if kinds.get(c) in ("float", "double")})


def co_register(layers: dict[str, DataFrame], base: str | None = None) -> DataFrame:
    """One row per pixel (prow, pcol) with a column per layer table (prow, pcol, <name>); a hash join on the pixel key.

    With a base layer its pixels decide; without one, all pixels of any layer. The tables share one partitioning, so each
    is shuffled once at most, and not at all where they are bucketed by the key.
    """
    names = sorted(layers, key=lambda n: n != base)
    how = "left" if base in layers else "full"
    return reduce(lambda a, b: a.join(layers[b].select(*KEY, b), KEY, how), names[1:], layers[names[0]].select(*KEY, names[0]))


def tiles_of(df: DataFrame) -> DataFrame:
    t = lambda c: F.floor(F.col(c) / TILE_PIXELS).cast("long")
    return df.select(t("prow").alias("tile_y"), t("pcol").alias("tile_x")).distinct()


def fill_missing(df: DataFrame, layer: str, present: DataFrame, value: int | float | Column = 0) -> DataFrame:
    """Pixels of tiles that a layer has no data for get `value`; null pixels of present tiles stay null.

    present: (tile_y, tile_x) of the layer's data, a row per tile, so 260,000 rows at most on the finest grid.
    """
    t = lambda c: F.floor(F.col(c) / TILE_PIXELS).cast("long")
    marked = df.withColumns({"tile_y": t("prow"), "tile_x": t("pcol")}).join(present.select("tile_y", "tile_x", F.lit(True).alias("_here")), ["tile_y", "tile_x"], "left")
    filled = F.when(F.col("_here").isNull(), F.coalesce(F.col(layer), F.lit(value).cast(df.schema[layer].dataType) if not isinstance(value, Column) else value)).otherwise(F.col(layer))
    return marked.withColumn(layer, filled).drop("tile_y", "tile_x", "_here")


def to_blocks(pixels: DataFrame, layers: list[str], size: int = 100) -> DataFrame:
    """Dense storage: a row per size x size block (block_y, block_x) with sorted cells (offset, layers...)."""
    b = lambda c: F.floor(F.col(c) / size).cast("long")
    at = (F.pmod("prow", F.lit(size)) * size + F.pmod("pcol", F.lit(size))).cast("int").alias("offset")
    return pixels.select(b("prow").alias("block_y"), b("pcol").alias("block_x"), F.struct(at, *layers).alias("cell")).groupBy("block_y", "block_x").agg(F.sort_array(F.collect_list("cell")).alias("cells"))


def from_blocks(blocks: DataFrame, size: int = 100) -> DataFrame:
    """Pixels (prow, pcol, layers...) of dense blocks; filters on block_y and block_x reach the scan."""
    cells = blocks.select("block_y", "block_x", F.explode("cells").alias("c")).select("block_y", "block_x", "c.*")
    row, col = F.floor(F.col("offset") / size), F.pmod("offset", F.lit(size))
    return cells.withColumns({"prow": F.col("block_y") * size + row, "pcol": F.col("block_x") * size + col}).drop("block_y", "block_x", "offset")
