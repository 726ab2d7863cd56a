"""Pixel areas on the WGS84 ellipsoid, in closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 semi-axes in metres.
MAJOR, MINOR = 6378137.0, 6356752.314245179
ECCENTRICITY = math.sqrt(1 - (MINOR / MAJOR) ** 2)


def pixel_area_ha(latitude: Column, width: float) -> Column:
    """Hectares of a pixel of `width` degrees whose southern edge is at latitude.

    The area between two latitudes, by differences that don't cancel: subtracting two areas from the equator would leave ten
    digits. Beyond a pole, where only synthetic rows are, the surface element goes on as in the queries' SQL: its sign is
    that of the latitude's cosine.
    """
    half = math.radians(width / 2)
    middle = F.radians(latitude + F.lit(width / 2))
    south, north = F.sin(middle - F.lit(half)), F.sin(middle + F.lit(half))
    rise = F.cos(middle) * F.lit(2 * math.sin(half))  # north - south
    e2 = ECCENTRICITY * ECCENTRICITY
    curve = F.atanh(ECCENTRICITY * rise / (1 - e2 * south * north)) / ECCENTRICITY
    plain = rise * (1 + e2 * south * north) / ((1 - e2 * south * south) * (1 - e2 * north * north))
    return (curve + plain) * (math.pi * MINOR**2 * width / 360 / 10000)


def tile_area_ha(tile_row: Column, width: float, tile_pixels: int) -> Column:
    """Hectares of every pixel of a row of tiles: its value at the tile's centre."""
    return pixel_area_ha((tile_row + 0.5) * (width * tile_pixels), width)
