"""Coordinates, distances, equal-angle cells and rings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def wrap_lon(lon: Column) -> Column:
    """A longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def chord_km(arc_km: Column) -> Column:
    """Straight-line length under an arc; the half angle is held to one radian."""
    half = F.least(F.greatest(arc_km / (2 * EARTH_KM), F.lit(0.0)), F.lit(1.0))
    return 2 * EARTH_KM * F.sin(half)


def unit_xyz(lat: Column, lon: Column, radius: float = EARTH_KM) -> list[Column]:
    return [radius * F.cos(F.radians(lat)) * F.cos(F.radians(lon)), radius * F.cos(F.radians(lat)) * F.sin(F.radians(lon)), radius * F.sin(F.radians(lat))]


def geo_bin(lat: Column, lon: Column) -> Column:
    """Coarse bin: six rows of 30 degrees times ten plus six columns of 60 degrees."""
    row = F.least(F.lit(5), F.greatest(F.lit(0), F.floor((lat + 90) / 30).cast("int")))
    col = F.least(F.lit(5), F.greatest(F.lit(0), F.floor((lon + 180) / 60).cast("int")))
    return (row * 10 + col).cast("int")


def grid_cell(lat: Column, lon: Column, degrees: float) -> Column:
    """Id of an equal-angle cell: row times the columns of a row, plus the column.

    Cells are not equal in area.  The upper edges belong to the last row and column.
    """
    rows, cols = math.ceil(180 / degrees), math.ceil(360 / degrees)
    row = F.least(F.floor((lat + 90) / degrees), F.lit(rows - 1))
    col = F.least(F.floor((lon + 180) / degrees), F.lit(cols - 1))
    return (row * cols + col).cast("long")


def cell_centre(cell: Column, degrees: float) -> tuple[Column, Column]:
    cols = math.ceil(360 / degrees)
    return F.floor(cell / cols) * degrees - 90 + degrees / 2, F.pmod(cell, F.lit(cols)) * degrees - 180 + degrees / 2


def cell_ring(lat: Column, lon: Column, degrees: float) -> Column:
    """Closed ring of the cell round a centre, counter-clockwise from the lower left."""
    half = degrees / 2
    corner = lambda dx, dy: F.struct((lon + dx * half).alias("lon"), (lat + dy * half).alias("lat"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))


def bbox_ring(lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column) -> Column:
    corner = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return F.array(corner(lon_min, lat_min), corner(lon_max, lat_min), corner(lon_max, lat_max), corner(lon_min, lat_max), corner(lon_min, lat_min))


def unwrap_ring(ring: Column, centre_lon: Column) -> Column:
    """Moves each vertex by whole turns to within half a turn of the centre."""
    def near(p: Column) -> Column:
        turns = F.floor((p["lon"] - centre_lon) / 360.0 + 0.5)
        return F.struct((p["lon"] - 360.0 * turns).alias("lon"), p["lat"].alias("lat"))

    return F.transform(ring, near)


def ring_span(ring: Column) -> Column:
    lons = F.transform(ring, lambda p: p["lon"])
    return F.array_max(lons) - F.array_min(lons)


def ring_bounds(ring: Column) -> dict[str, Column]:
    lons, lats = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return {"lon_min": F.array_min(lons), "lat_min": F.array_min(lats), "lon_max": F.array_max(lons), "lat_max": F.array_max(lats)}


def ring_area(ring: Column) -> Column:
    """Area within a closed ring in square degrees, below 0 if it runs clockwise."""
    n, o = F.size(ring), ring[0]
    # seen from its first point, so that far-off rings lose no digits
    edges = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda p, q: ((p["lon"] - o["lon"]) * (q["lat"] - o["lat"]) - (q["lon"] - o["lon"]) * (p["lat"] - o["lat"])) / 2)
    return F.aggregate(edges, F.lit(0.0), lambda t, e: t + e)


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Area centroid (lon, lat) of a closed ring, by cross products of its edges."""
    n = F.size(ring)
    edges = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda p, q: F.struct((p["lon"] * q["lat"] - q["lon"] * p["lat"]).alias("w"), (p["lon"] + q["lon"]).alias("x"), (p["lat"] + q["lat"]).alias("y")))

    def total(f) -> Column:
        return F.aggregate(edges, F.lit(0.0), lambda t, e: t + f(e))

    area = total(lambda e: e["w"]) * 3
    return total(lambda e: e["w"] * e["x"]) / area, total(lambda e: e["w"] * e["y"]) / area
