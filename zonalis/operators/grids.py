"""Grids as integer pixel coordinates: tiles, tile names and tile covers."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE_PIXELS = 5000


@dataclass(frozen=True)
class Grid:
    """A file is `degrees` wide and `pixels` across; a tile is TILE_PIXELS across. Rows run north, columns east, from 0/0."""

    degrees: int
    pixels: int

    @classmethod
    def of(cls, name: str) -> Grid:
        degrees, pixels = name.split("/")
        return cls(int(degrees), int(pixels))

    @property
    def width(self) -> float:
        return self.degrees / self.pixels

    @property
    def tile_degrees(self) -> float:
        return float(Fraction(self.degrees, self.pixels) * TILE_PIXELS)

    def index(self, degrees: Column) -> Column:
        """Pixel row or column that holds a coordinate."""
        return F.floor(degrees * F.lit(float(self.pixels)) / F.lit(float(self.degrees))).cast("long")

    def centre(self, index: Column) -> Column:
        return (index + 0.5) * F.lit(self.width)

    def tile(self, index: Column) -> Column:
        return F.floor(index / TILE_PIXELS).cast("long")


def _letter(value: Column, digits: int, plus: str, minus: str) -> Column:
    return F.concat(F.lpad(F.abs(value).cast("string"), digits, "0"), F.when(value >= 0, plus).otherwise(minus))


def tile_id_nw(longitude: Column, latitude: Column, grid: Grid) -> Column:
    """Name of the file that holds a point, by its north-west corner, e.g. 10N_100E."""
    north = (F.ceil(latitude / grid.degrees) * grid.degrees).cast("int")
    west = (F.floor(longitude / grid.degrees) * grid.degrees).cast("int")
    return F.concat(_letter(north, 2, "N", "S"), F.lit("_"), _letter(west, 3, "E", "W"))


def tile_id_nwse(longitude: Column, latitude: Column, grid: Grid) -> Column:
    """Name of the file that holds a point, by its west, south, east and north bounds, e.g. 100E_00N_110E_10N."""
    north = (F.ceil(latitude / grid.degrees) * grid.degrees).cast("int")
    west = (F.floor(longitude / grid.degrees) * grid.degrees).cast("int")
    south, east = north - grid.degrees, west + grid.degrees
    return F.concat_ws("_", _letter(west, 3, "E", "W"), _letter(south, 2, "N", "S"), _letter(east, 3, "E", "W"), _letter(north, 2, "N", "S"))


def file_name(file_y: int, file_x: int, grid: Grid, scheme: str = "nw") -> str:
    """Name of a file by its place, in degrees from 0/0 divided by the file's size; schemes nw and nwse as above."""
    south, west = file_y * grid.degrees, file_x * grid.degrees
    north, east = south + grid.degrees, west + grid.degrees
    lat = lambda v: f"{abs(v):02d}{'N' if v >= 0 else 'S'}"
    lon = lambda v: f"{abs(v):03d}{'E' if v >= 0 else 'W'}"
    if scheme not in ("nw", "nwse"):
        raise ValueError(f"unknown tile scheme {scheme!r}")
    return f"{lat(north)}_{lon(west)}" if scheme == "nw" else f"{lon(west)}_{lat(south)}_{lon(east)}_{lat(north)}"


def tile_cover(boxes: DataFrame, grid: Grid) -> DataFrame:
    """(fid, tile_x, tile_y) of all tiles under the bounding boxes (fid, west, south, east, north)."""
    t = grid.tile_degrees
    low = lambda c: F.floor(F.col(c) / t).cast("long")
    high = lambda a, b: F.greatest(F.ceil(F.col(b) / t).cast("long") - 1, low(a))
    across = boxes.select("fid", F.explode(F.sequence(low("west"), high("west", "east"))).alias("tile_x"), "south", "north")
    return across.select("fid", "tile_x", F.explode(F.sequence(low("south"), high("south", "north"))).alias("tile_y"))
