"""A hexagonal index of the globe: cells of equal area, with parents, neighbours, boundaries and polygon fill.

Points are projected by the cylindrical equal-area map with 30 degrees as
standard parallel and dealt to a lattice of regular hexagons, so all cells
have one area, save those that the poles cut.  A level has 12 * 2 ** level
hexagons round a parallel, so the lattice closes at the date line, and a
cell has four children.

On the map a place is (u, v): columns east of the date line, and rows north
of the equator.  A cell has axial coordinates: row r, and column q, its
centre at u = q + r / 2, v = r.  Its id is one long: level, row, column.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from phenogrid.functions.geo import EARTH_KM

BASE = 12  # hexagons round the globe at level 0
MOST_LEVEL = 25
ROW_BITS, LEVEL_BITS = 29, 58
EQUATOR = 1 << 28  # what is added to a row, so that it is no negative number
ROWS_PER_COLUMN = 4 / (3 * math.sqrt(3) * math.pi)  # rows from the equator to a pole, of each column round the globe
CORNERS = ((0.5, -1 / 3), (0.5, 1 / 3), (0.0, 2 / 3), (-0.5, 1 / 3), (-0.5, -1 / 3), (0.0, -2 / 3), (0.5, -1 / 3))
STEPS = ((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1))


def columns(level: int) -> int:
    """Hexagons round the globe."""
    if not 0 <= level <= MOST_LEVEL:
        raise ValueError(f"level must be from 0 to {MOST_LEVEL}")
    return BASE << level


def rows(level: int) -> float:
    """Rows from the equator to a pole; the last one is cut."""
    return columns(level) * ROWS_PER_COLUMN


def area_km2(level: int) -> float:
    """Area of every cell that no pole cuts."""
    return 4 * math.pi * EARTH_KM**2 / (2 * rows(level) * columns(level))


def cell_of(q: Column, r: Column, level: int) -> Column:
    """Id of the cell at axial coordinates; columns count round the globe."""
    n = columns(level)
    return F.lit(level << LEVEL_BITS) + (r.cast("long") + EQUATOR) * (1 << ROW_BITS) + F.pmod(q.cast("long"), F.lit(n))


def column_of(cell: Column) -> Column:
    return F.pmod(cell, F.lit(1 << ROW_BITS))


def row_of(cell: Column) -> Column:
    return F.pmod(F.shiftright(cell, ROW_BITS), F.lit(1 << (LEVEL_BITS - ROW_BITS))) - EQUATOR


def sine(angle: Column) -> Column:
    """Sine as the C library rounds it; null where there is no number.

    The last bit decides for a point halfway between two centres, and Java's
    sine differs there from other engines' now and then.
    """
    @F.pandas_udf("double")
    def of_each(angles: pd.Series) -> pd.Series:
        return angles.where(np.isfinite(angles)).map(math.sin)

    return of_each(angle)


def map_place(lat: Column, lon: Column, level: int) -> tuple[Column, Column]:
    """(u, v) of a point."""
    return (lon + 180.0) * (columns(level) / 360.0), sine(F.radians(lat)) * rows(level)


def latitude(v: Column, level: int) -> Column:
    """Latitude of a row of the map; beyond a pole, the pole's."""
    return F.degrees(F.asin(F.least(F.greatest(v / rows(level), F.lit(-1.0)), F.lit(1.0))))


def longitude(u: Column, level: int) -> Column:
    """Longitude of a column of the map, on past 180 degrees for columns past the date line."""
    return u * (360.0 / columns(level)) - 180.0


def point_cell(lat: Column, lon: Column, level: int) -> Column:
    """The cell that holds a point: the nearest centre on the map, found among axial coordinates by rounding."""
    u, v = map_place(lat, lon, level)
    x, z = u - v / 2, v

    def nearest(c: Column) -> Column:
        return F.floor(c + 0.5)

    y = -x - z
    rx, ry, rz = nearest(x), nearest(y), nearest(z)
    dx, dy, dz = F.abs(rx - x), F.abs(ry - y), F.abs(rz - z)
    worst_x, worst_z = (dx > dy) & (dx > dz), ~((dx > dy) & (dx > dz)) & ~(dy > dz)
    return cell_of(F.when(worst_x, -ry - rz).otherwise(rx), F.when(worst_z, -rx - ry).otherwise(rz), level)


def centre(cell: Column, level: int) -> tuple[Column, Column]:
    """(lat, lon) of a cell's centre; beyond a pole, on it."""
    r = row_of(cell)
    lon = longitude(F.pmod(column_of(cell) + r / 2, F.lit(float(columns(level)))), level)
    return latitude(r.cast("double"), level), lon


def boundary(cell: Column, level: int) -> Column:
    """Closed ring of a cell, counter-clockwise; longitudes run on past the date line."""
    r = row_of(cell)
    u = F.pmod(column_of(cell) + r / 2, F.lit(float(columns(level))))
    return F.array(*[F.struct(longitude(u + du, level).alias("lon"), latitude(r + dv, level).alias("lat")) for du, dv in CORNERS])


def on_globe(r: Column, level: int) -> Column:
    """Whether any of a row's cells lies on the globe."""
    return F.abs(r) - 2 / 3 < rows(level)


def whole(cell: Column, level: int) -> Column:
    """Whether no pole cuts the cell."""
    return F.abs(row_of(cell)) + 2 / 3 <= rows(level)


def neighbours(cell: Column, level: int) -> Column:
    """The six cells round a cell, in turn from the east; at a pole those that lie on the globe."""
    return disk_at(cell, level, F.array(*[F.struct(F.lit(dq).alias("dq"), F.lit(dr).alias("dr")) for dq, dr in STEPS]))


def disk_at(cell: Column, level: int, steps: Column) -> Column:
    """Cells at an array of steps (dq, dr) from a cell."""
    q, r = column_of(cell), row_of(cell)
    there = F.filter(steps, lambda s: on_globe(r + s["dr"], level))
    return F.transform(there, lambda s: cell_of(q + s["dq"], r + s["dr"], level))


def disk(cell: Column, level: int, k: int) -> Column:
    """All cells within ``k`` steps of a cell, itself included."""
    if 2 * k + 1 > columns(level):
        raise ValueError("the disk would meet itself round the globe")
    steps = [(dq, dr) for dq in range(-k, k + 1) for dr in range(max(-k, -dq - k), min(k, -dq + k) + 1)]
    return disk_at(cell, level, F.array(*[F.struct(F.lit(dq).alias("dq"), F.lit(dr).alias("dr")) for dq, dr in steps]))


def distance(a: Column, b: Column, level: int) -> Column:
    """Steps from one cell to another, the shorter way round the globe."""
    n, dr = columns(level), row_of(a) - row_of(b)
    ways = [(F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2 for dq in (column_of(a) - column_of(b) + shift * n for shift in (-2, -1, 0, 1, 2))]
    return F.least(*ways).cast("long")


def parent(cell: Column, level: int) -> Column:
    """The cell of the level above whose centre is nearest; of the two nearest, the one to the west or north-west."""
    q, r = column_of(cell), row_of(cell)
    both_odd = F.pmod(q, F.lit(2)) * F.pmod(r, F.lit(2))
    return cell_of(F.floor(q / 2), F.floor(r / 2) + both_odd, level - 1)


def children(cell: Column, level: int) -> Column:
    """The four cells of the level below whose parent is the cell."""
    q, r = column_of(cell) * 2, row_of(cell) * 2
    return F.array(*[cell_of(q + dq, r + dr, level + 1) for dq, dr in ((0, 0), (1, 0), (0, 1), (1, -1))])


def ring_area_km2(ring: Column) -> Column:
    """Area on the sphere inside a ring whose edges are straight on an equal-area map."""
    n = F.size(ring)
    edges = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda p, q: F.radians(p["lon"] - q["lon"]) * (F.sin(F.radians(p["lat"])) + F.sin(F.radians(q["lat"]))) / 2)
    return F.aggregate(edges, F.lit(0.0), lambda t, e: t + e) * EARTH_KM**2


def level_for_km(km: Column) -> Column:
    """The level whose cells' longer diagonal, at the standard parallel, is nearest to a length; the coarser of two."""
    # a cell is a column wide and 2 / sqrt(3) of that from corner to corner
    across = [2 * math.pi * EARTH_KM * math.cos(math.radians(30)) / columns(level) * 2 / math.sqrt(3) for level in range(MOST_LEVEL + 1)]
    return F.array_min(F.array(*[F.struct(F.abs(km - d).alias("off"), F.lit(level).alias("level")) for level, d in enumerate(across)]))["level"]
