"""Queries of cells, rings, neighbours, regions and propagation."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from phenogrid.functions import geo
from phenogrid.operators import environment, propagation, repair
from phenogrid.operators.stored import stored
from phenogrid.plans.ingest import HAVERSINE
from phenogrid.plans.tables import Tables, sql

QUERIES: dict = {}


def query(text: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = (f, text)
        return f

    return keep


@query(sql("SELECT cell, CAST(least(floor((lat + 90) / 5), 35) * 72 + least(floor((lon + 180) / 5), 71) AS BIGINT) AS grid_cell FROM cells", "cells"))
def point_to_cell(t: Tables):
    return t.cells().select("cell", geo.grid_cell(F.col("lat"), F.col("lon"), 5.0).alias("grid_cell"))


GRID = "g AS (SELECT cell, CAST(least(floor((lat + 90) / 5), 35) * 72 + least(floor((lon + 180) / 5), 71) AS BIGINT) AS gc FROM cells)"


@query(sql("SELECT cell, floor(gc / 72) * 5 - 90 + 2.5::DOUBLE AS lat, (gc % 72) * 5 - 180 + 2.5::DOUBLE AS lon FROM g", "cells", more=GRID))
def cell_centre(t: Tables):
    lat, lon = geo.cell_centre(geo.grid_cell(F.col("lat"), F.col("lon"), 5.0), 5.0)
    return t.cells().select("cell", lat.alias("lat"), lon.alias("lon"))


@query(sql("SELECT cell, CAST(i AS INTEGER) AS i, lon + (CASE WHEN i IN (0, 3, 4) THEN -2.5 ELSE 2.5 END)::DOUBLE AS x, lat + (CASE WHEN i IN (0, 1, 4) THEN -2.5 ELSE 2.5 END)::DOUBLE AS y FROM cells CROSS JOIN range(0, 5) r(i)", "cells"))
def cell_boundary(t: Tables):
    return t.cells().select("cell", F.posexplode(geo.cell_ring(F.col("lat"), F.col("lon"), 5.0)).alias("i", "p")).select("cell", "i", F.col("p.lon").alias("x"), F.col("p.lat").alias("y"))


def rings(t: Tables):
    """Ten-degree squares; their vertices lie within [-180, 180), so some are split by the date line."""
    ring = F.transform(geo.cell_ring(F.col("lat"), F.col("lon"), 10.0), lambda p: F.struct(geo.wrap_lon(p["lon"]).alias("lon"), p["lat"].alias("lat")))
    return t.cells().select("cell", "lat", "lon", ring.alias("ring"))


CORNER = "corner AS (SELECT cell, lat, lon, i, ((lon + (CASE WHEN i IN (0, 3, 4) THEN -5 ELSE 5 END) + 180) % 360 + 360) % 360 - 180 AS x, lat + (CASE WHEN i IN (0, 1, 4) THEN -5 ELSE 5 END) AS y FROM cells CROSS JOIN range(0, 5) r(i))"


@query(sql("SELECT cell, CAST(i AS INTEGER) AS i, round(x - 360 * floor((x - lon) / 360 + 0.5), 6)::DOUBLE AS x FROM corner", "cells", more=CORNER))
def ring_unwrap(t: Tables):
    return rings(t).select("cell", F.posexplode(geo.unwrap_ring(F.col("ring"), F.col("lon"))).alias("i", "p")).select("cell", "i", F.round("p.lon", 6).alias("x"))


@query(sql("SELECT cell, round(max(x) - min(x), 6) AS span FROM corner GROUP BY cell, lat HAVING max(x) - min(x) <= 180 AND max(y) <= 90 AND min(y) >= -90", "cells", more=CORNER))
def span_filter(t: Tables):
    from phenogrid.sources.writers import valid_cells

    return valid_cells(rings(t)).select("cell", F.round(geo.ring_span(F.col("ring")), 6).alias("span"))


@query(sql("SELECT cell, round(min(x), 6) AS lon_min, round(min(y), 6)::DOUBLE AS lat_min, round(max(x), 6) AS lon_max, round(max(y), 6)::DOUBLE AS lat_max FROM corner GROUP BY cell", "cells", more=CORNER))
def ring_bounds(t: Tables):
    b = geo.ring_bounds(F.col("ring"))
    return rings(t).select("cell", *[F.round(c, 6).alias(n) for n, c in b.items()])


@query(sql("SELECT cell, round(lon, 4) + 0.0 AS x, round(lat, 4) + 0.0 AS y FROM cells", "cells"))
def polygon_centroid(t: Tables):
    lon, lat = geo.ring_centroid(geo.cell_ring(F.col("lat"), F.col("lon"), 4.0))
    return t.cells().select("cell", (F.round(lon, 4) + 0.0).alias("x"), (F.round(lat, 4) + 0.0).alias("y"))


STAR = [(math.cos(math.pi / 2 + i * 4 * math.pi / 5), math.sin(math.pi / 2 + i * 4 * math.pi / 5)) for i in range(5)]
#: Faulty rings by kind: doubled points, a bow-tie, a spike, a star, a square run round twice, a hole on a bridge; rings and area that are left.
FAULTY = [
    ([(0, 0), (0, 0), (4, 0), (4, 3), (4, 3), (0, 3)], 1, 12.0), ([(0, 0), (4, 3), (4, 0), (0, 3)], 2, 6.0), ([(0, 0), (4, 0), (4, 3), (7, 3), (4, 3), (0, 3)], 1, 12.0),
    (STAR, 1, 10 * math.tan(math.pi / 10) / (3 - math.tan(math.pi / 10) ** 2)), ([(0, 0), (4, 0), (4, 3), (0, 3)] * 2, 1, 12.0), ([(0, 0), (6, 0), (6, 6), (0, 6), (0, 0), (2, 2), (2, 4), (4, 4), (4, 2), (2, 2)], 2, 32.0),
]


@query(sql("SELECT cell, n_rings, round(area * (1 + cell % 7) * (1 + cell % 7), 5) AS area FROM compact JOIN (VALUES " + ", ".join(f"({i}, {n}, {area!r}::DOUBLE)" for i, (_, n, area) in enumerate(FAULTY)) + ") k(kind, n_rings, area) ON kind = cell % 6", "compact"))
def polygon_repair(t: Tables):
    """Faulty rings round each place, repaired: rings left, and their area in square degrees."""
    size = 1 + F.col("cell") % 7
    ring = F.element_at(F.array(*[F.array(*[F.struct((F.col("lon") + x * size).alias("lon"), (F.col("lat") + y * size).alias("lat")) for x, y in points]) for points, _, _ in FAULTY]), (F.col("cell") % 6 + 1).cast("int"))
    fixed = repair.repair_rings(t.compact().select("cell", ring.alias("ring")))
    return fixed.select("cell", F.size("rings").alias("n_rings"), F.round(F.aggregate(F.transform("rings", geo.ring_area), F.lit(0.0), lambda s, a: s + a), 5).alias("area"))


@query("SELECT name, i, x, y FROM (SELECT r_name AS name, r_regionkey * 10.0::DOUBLE AS x0, r_regionkey * 5.0::DOUBLE AS y0 FROM region) CROSS JOIN (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) c(i, dx, dy) CROSS JOIN LATERAL (SELECT x0 + dx * 8.0::DOUBLE AS x, y0 + dy * 4.0::DOUBLE AS y)")
def bbox_ring(t: Tables):
    r = t.read("region").selectExpr("r_name as name", "r_regionkey * 10.0D as x0", "r_regionkey * 5.0D as y0")
    ring = geo.bbox_ring(F.col("x0"), F.col("y0"), F.col("x0") + 8.0, F.col("y0") + 4.0)
    return r.select("name", F.posexplode(ring).alias("i", "p")).select("name", "i", F.col("p.lon").alias("x"), F.col("p.lat").alias("y"))


SIZES = (0.5, 1.0, 2.0, 5.0, 10.0)


@query("SELECT km, arg_min(degrees, (abs(degrees * 111.0 * sqrt(2.0) - km), degrees)) AS degrees FROM (SELECT DISTINCT (p_size * 20)::DOUBLE AS km FROM part) CROSS JOIN (VALUES " + ", ".join(f"({d}::DOUBLE)" for d in SIZES) + ") s(degrees) GROUP BY km")
def resolution_for_km(t: Tables):
    """The cell size whose diagonal at the equator is nearest to a wanted length."""
    sizes = F.array(*map(F.lit, SIZES))
    km = t.read("part").select((F.col("p_size") * 20).cast("double").alias("km")).distinct()
    best = F.array_min(F.transform(sizes, lambda d: F.struct(F.abs(d * 111.0 * F.sqrt(F.lit(2.0)) - F.col("km")).alias("off"), d.alias("degrees"))))
    return km.select("km", best["degrees"].alias("degrees"))


@query(sql("SELECT name, cell FROM regions JOIN cells ON lon BETWEEN lon_min AND lon_max AND lat BETWEEN lat_min AND lat_max", "regions", "cells"))
def range_join_regions(t: Tables):
    """Region boxes hold a point; the regions are a fixed table of twenty rows."""
    r = t.regions()
    return t.cells().join(F.broadcast(r), F.col("lon").between(F.col("lon_min"), F.col("lon_max")) & F.col("lat").between(F.col("lat_min"), F.col("lat_max"))).select("name", "cell")


@query(sql("SELECT name, CAST(row_number() OVER (ORDER BY round((lon_max - lon_min) * (lat_max - lat_min), 6) DESC, name) AS INTEGER) AS place FROM boxes QUALIFY place <= 50", "boxes"))
def sort_bbox_area(t: Tables):
    """The fifty boxes to be drawn first, the largest before smaller ones."""
    area = F.round((F.col("lon_max") - F.col("lon_min")) * (F.col("lat_max") - F.col("lat_min")), 6)
    first = t.boxes().select("name", area.alias("area")).orderBy(F.desc("area"), "name").limit(50)
    return first.select("name", F.row_number().over(Window.orderBy(F.desc("area"), "name")).alias("place"))


@query(sql("SELECT cell FROM cells ORDER BY (lat - 50.8) * (lat - 50.8) + (lon - 12.9) * (lon - 12.9), lat, lon, cell LIMIT 1", "cells"))
def nearest_cell(t: Tables):
    d2 = (F.col("lat") - 50.8) * (F.col("lat") - 50.8) + (F.col("lon") - 12.9) * (F.col("lon") - 12.9)
    return t.cells().orderBy(d2, "lat", "lon", "cell").limit(1).select("cell")


# of each column by itself: cells that lack it and have another value, and their three nearest that have it
NEAREST = """near_{c} AS (SELECT e.cell, f.cell AS near, f.{c} AS value, row_number() OVER (PARTITION BY e.cell ORDER BY round(sqrt((e.lat - f.lat) * (e.lat - f.lat) + (e.lon - f.lon) * (e.lon - f.lon)), 9), f.cell) AS rn
 FROM cells e JOIN cells f ON e.{c} IS NULL AND {others} AND f.{c} IS NOT NULL QUALIFY rn <= 3)"""
FILLED = {"elevation": "(e.landcover IS NOT NULL OR e.water IS NOT NULL)", "landcover": "(e.elevation IS NOT NULL OR e.water IS NOT NULL)", "water": "(e.elevation IS NOT NULL OR e.landcover IS NOT NULL)"}
NEAR_ALL = ",\n".join(NEAREST.format(c=c, others=o) for c, o in FILLED.items())


@query(sql(" UNION ALL ".join(f"SELECT '{c}' AS filled, cell, near, CAST(rn AS INTEGER) AS rn FROM near_{c}" for c in FILLED), "cells", more=NEAR_ALL))
def knn_neighbours(t: Tables):
    return environment.nearest_filled(t.cells(), list(FILLED), list(FILLED), 3).select("filled", "cell", "near", "rn")


@query(sql("""SELECT c.cell, coalesce(c.elevation, (SELECT round(avg(value), 6) FROM near_elevation n WHERE n.cell = c.cell)) AS elevation,
 coalesce(c.landcover, (SELECT value FROM near_landcover n WHERE n.cell = c.cell GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)) AS landcover,
 coalesce(c.water, (SELECT round(avg(value), 6) FROM near_water n WHERE n.cell = c.cell)) AS water FROM cells c""", "cells", more=NEAR_ALL))
def knn_impute(t: Tables):
    was = t.cells().select("cell", F.col("elevation").alias("e"), F.col("water").alias("w"))
    out = environment.impute(t.cells(), ["elevation", "water"], ["landcover"]).join(was, "cell")
    return out.select("cell", F.coalesce("e", F.round("elevation", 6)).alias("elevation"), "landcover", F.coalesce("w", F.round("water", 6)).alias("water"))


K, LEAST, RADIUS, SPREAD, GATE, CAP = 10, 4, 3000.0, 2.0, 2.0, 500.0
ENV = ["elevation", "landcover"]


def samples(t: Tables):
    return t.sets().join(t.compact(), "cell").select("cell", "week", "lat", "lon", "species", *ENV)


Z = ", ".join(f"coalesce(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 0) AS z_{c}" for c in ENV)
PROP = f"""s AS (SELECT cell, week, lat, lon, species, {Z} FROM sets JOIN compact USING (cell)),
knn AS (SELECT a.cell, a.week, a.lat, a.lon, b.cell AS near, sqrt(pow(a.z_elevation - b.z_elevation, 2) + pow(a.z_landcover - b.z_landcover, 2)) AS env_dist, {HAVERSINE.format(a='a.', b='b.')} AS km,
 row_number() OVER (PARTITION BY a.cell, a.week ORDER BY round(sqrt(pow(a.z_elevation - b.z_elevation, 2) + pow(a.z_landcover - b.z_landcover, 2)), 9), b.cell) AS rn
 FROM s a JOIN s b ON a.week = b.week AND len(a.species) < {LEAST} AND len(b.species) >= {LEAST})"""


@query(sql(f"SELECT cell, week, near, CAST(rn AS INTEGER) AS rn, round(km, 5) AS km FROM knn WHERE rn <= {K}", "sets", "compact", more=PROP))
def knn_env_join(t: Tables):
    return propagation.nearest_in_environment(samples(t), ENV, K, LEAST).select("cell", "week", "near", "rn", F.round("km", 5).alias("km"))


RANGES = PROP + f""", each AS (SELECT cell, lat, lon, unnest(species) AS species FROM s WHERE len(species) >= {LEAST}),
lim AS (SELECT species, count(*) AS n_obs, least({CAP}, {SPREAD} * greatest(50.0, 0.5 * sqrt(pow(6371.0 * radians(max(lat) - min(lat)), 2) + pow(6371.0 * radians(max(lon) - min(lon)) * cos(radians(avg(lat))), 2)))) AS max_km FROM each GROUP BY species)"""


@query(sql("SELECT species, n_obs, round(max_km, 6)::DOUBLE AS max_km FROM lim", "sets", "compact", more=RANGES))
def species_range(t: Tables):
    each = samples(t).where(F.size("species") >= LEAST).select("lat", "lon", F.explode("species").alias("species"))
    return propagation.species_ranges(each, SPREAD, CAP).withColumn("max_km", F.round("max_km", 6))


WANTED = RANGES + f""", cand AS (SELECT DISTINCT k.cell, k.week, k.lat, k.lon, x.species FROM knn k JOIN (SELECT cell AS near, week, unnest(species) AS species FROM s WHERE len(species) >= {LEAST}) x ON x.near = k.near AND x.week = k.week WHERE rn <= {K} AND km <= {RADIUS} AND env_dist <= {GATE}),
places AS (SELECT DISTINCT species, lat, lon FROM each),
ok AS (SELECT DISTINCT c.cell, c.species FROM (SELECT DISTINCT cell, lat, lon, species FROM cand) c JOIN lim USING (species) JOIN places p ON p.species = c.species WHERE {HAVERSINE.format(a='c.', b='p.')} <= max_km),
added AS (SELECT cell, week, list(species) AS added FROM cand JOIN ok USING (cell, species) GROUP BY cell, week),
after_t AS (SELECT s.cell, s.week, s.species AS was, list_sort(list_distinct(list_concat(s.species, coalesce(a.added, [])))) AS now FROM s LEFT JOIN added a ON a.cell = s.cell AND a.week = s.week)"""


PARAMETERS = (ENV, K, RADIUS, LEAST, SPREAD, GATE, CAP)


@query(sql("SELECT cell, week, array_to_string(now, ',') AS species FROM after_t", "sets", "compact", more=WANTED))
def propagate_labels(t: Tables):
    return propagation.propagate(samples(t), *PARAMETERS).select("cell", "week", F.array_join("species", ",").alias("species"))


@query(sql("SELECT week, count(*) AS n_samples, count(*) FILTER (WHERE len(now) > len(was)) AS n_modified, CAST(sum(len(now) - len(was)) AS BIGINT) AS n_added FROM after_t GROUP BY week", "sets", "compact", more=WANTED))
def propagation_summary(t: Tables):
    return propagation.summary(propagation.additions(samples(t), *PARAMETERS))


@query(sql("SELECT week, len(was) AS n_before, len(now) AS n_after FROM after_t WHERE cell = (SELECT min(cell) FROM after_t WHERE len(now) > len(was))", "sets", "compact", more=WANTED))
def propagation_weekly(t: Tables):
    """Species before and after at the first cell that changed; the propagated table is worked out once."""
    was, added = F.size("species").cast("long"), F.size("added").cast("long")
    both = stored(propagation.additions(samples(t), *PARAMETERS).select("cell", "week", was.alias("n_before"), (was + added).alias("n_after")))
    first = both.where("n_after > n_before").agg(F.min("cell").alias("cell"))
    return both.join(F.broadcast(first), "cell").select("week", "n_before", "n_after")
