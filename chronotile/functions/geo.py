"""Slippy-map tile math as Column expressions (Web Mercator, col = x, row = y).

All functions return JVM-side expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.320


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def _n(zoom: int) -> Column:
    return F.lit(float(2**zoom))


def lon_to_col(lon, zoom: int = 16) -> Column:
    return F.floor((_c(lon) + 180.0) / 360.0 * _n(zoom)).cast("int")


def lat_to_row(lat, zoom: int = 16) -> Column:
    rad = F.radians(_c(lat))
    merc = F.ln(F.tan(rad) + F.lit(1.0) / F.cos(rad)) / F.lit(math.pi)
    return F.floor((F.lit(1.0) - merc) / 2.0 * _n(zoom)).cast("int")


def col_to_lon(col, zoom: int = 16) -> Column:
    """Accepts fractional columns (used by mask polygons)."""
    return _c(col).cast("double") / _n(zoom) * 360.0 - 180.0


def row_to_lat(row, zoom: int = 16) -> Column:
    """Accepts fractional rows."""
    y = F.lit(1.0) - F.lit(2.0) * _c(row).cast("double") / _n(zoom)
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * y)))


def tile_bounds(col, row, zoom: int = 16) -> Column:
    c, r = _c(col), _c(row)
    return F.struct(
        col_to_lon(c, zoom).alias("west"),
        row_to_lat(r + 1, zoom).alias("south"),
        col_to_lon(c + 1, zoom).alias("east"),
        row_to_lat(r, zoom).alias("north"),
    )


def ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Closed outer ring SW, SE, NE, NW, SW as array<array<double>>."""
    return F.array(
        F.array(west, south),
        F.array(east, south),
        F.array(east, north),
        F.array(west, north),
        F.array(west, south),
    )


def tile_ring(col, row, zoom: int = 16) -> Column:
    c, r = _c(col), _c(row)
    return ring(col_to_lon(c, zoom), row_to_lat(r + 1, zoom), col_to_lon(c + 1, zoom), row_to_lat(r, zoom))


def polygon_struct(rings: Column) -> Column:
    """GeoJSON Polygon as a struct (type, coordinates); ``to_json`` gives the text form."""
    return F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))


def tile_polygon_json(col, row, zoom: int = 16) -> Column:
    return F.to_json(polygon_struct(F.array(tile_ring(col, row, zoom))))


def tile_centroid_lon(col, zoom: int = 16) -> Column:
    c = _c(col)
    return (col_to_lon(c, zoom) + col_to_lon(c + 1, zoom)) / 2.0


def tile_centroid_lat(row, zoom: int = 16) -> Column:
    r = _c(row)
    return (row_to_lat(r + 1, zoom) + row_to_lat(r, zoom)) / 2.0


def km_scale(lat) -> Column:
    """Kilometres per degree of longitude at a latitude."""
    return F.lit(KM_PER_DEGREE) * F.cos(F.radians(_c(lat)))


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    la1, la2 = _c(lat1), _c(lat2)
    d_lat = F.radians(la2 - la1)
    d_lon = F.radians(_c(lon2) - _c(lon1))
    h = F.pow(F.sin(d_lat / 2.0), 2) + F.cos(F.radians(la1)) * F.cos(F.radians(la2)) * F.pow(F.sin(d_lon / 2.0), 2)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(h))


def viewport_range(west: float, south: float, east: float, north: float, zoom: int = 16) -> tuple[int, int, int, int]:
    """Driver-side twin for literal viewports: (min_col, max_col, min_row, max_row); north gives min row."""
    n = 2**zoom

    def col(lon):
        return int(math.floor((lon + 180.0) / 360.0 * n))

    def row(lat):
        rad = math.radians(lat)
        return int(math.floor((1.0 - math.log(math.tan(rad) + 1.0 / math.cos(rad)) / math.pi) / 2.0 * n))

    return col(west), col(east), row(north), row(south)


def viewport_ranges(viewports, zoom: int = 16):
    """Tile ranges for a DataFrame of viewports (west, south, east, north)."""
    return viewports.select(
        "*",
        lon_to_col("west", zoom).alias("min_col"),
        lon_to_col("east", zoom).alias("max_col"),
        lat_to_row("north", zoom).alias("min_row"),
        lat_to_row("south", zoom).alias("max_row"),
    )


def cell_for_zoom(z) -> Column:
    """Grid cell edge in tiles for a map zoom: max(1, 2^max(0, 16 - z))."""
    return F.greatest(F.lit(1), F.pow(F.lit(2.0), F.greatest(F.lit(0), F.lit(16) - _c(z))).cast("int"))
