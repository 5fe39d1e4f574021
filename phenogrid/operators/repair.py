"""Repair of polygon rings: crossings, doubled points and spikes."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.operators.stored import dealt

RINGS_PER_TASK = 4096
RINGS = "array<array<struct<lon:double,lat:double>>>"
DIGITS = 9  # of a degree: places that agree so far are one


def _edges(ring: list) -> list:
    """Edges between unlike places that follow each other, the last one back to the first."""
    places = [(round(x, DIGITS) + 0.0, round(y, DIGITS) + 0.0) for x, y in ring]
    return [(a, b) for a, b in zip(places, places[1:] + places[:1]) if a != b]


def _cuts(a, b, c, d) -> list:
    """Places on edge ab where edge cd crosses or touches it, or begins or ends to run along it."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = a, b, c, d
    ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
    turn, far = ux * vy - uy * vx, 10.0**-DIGITS
    if abs(turn) > far * far:
        s, t = ((cx - ax) * vy - (cy - ay) * vx) / turn, ((cx - ax) * uy - (cy - ay) * ux) / turn
        s_slack, t_slack = far / math.hypot(ux, uy), far / math.hypot(vx, vy)
        return [(ax + s * ux, ay + s * uy)] if -s_slack <= s <= 1 + s_slack and -t_slack <= t <= 1 + t_slack else []
    long = math.hypot(ux, uy)
    on = [p for p in (c, d) if abs((p[0] - ax) * uy - (p[1] - ay) * ux) <= far * long]
    return [p for p in on if 0 < (p[0] - ax) * ux + (p[1] - ay) * uy < long * long]


def _pieces(ring: list) -> dict:
    """Edges cut where they meet, as pairs of places in order, with how much oftener they are run forward than back."""
    edges, net = _edges(ring), Counter()
    for i, (a, b) in enumerate(edges):
        places = {a, b}
        for j, (c, d) in enumerate(edges):
            if i != j and min(c[0], d[0]) <= max(a[0], b[0]) + 1e-8 and max(c[0], d[0]) >= min(a[0], b[0]) - 1e-8 and min(c[1], d[1]) <= max(a[1], b[1]) + 1e-8 and max(c[1], d[1]) >= min(a[1], b[1]) - 1e-8:
                places |= {(round(x, DIGITS) + 0.0, round(y, DIGITS) + 0.0) for x, y in _cuts(a, b, c, d)}
        line = sorted(places, key=lambda p: (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]))
        for p, q in zip(line, line[1:]):
            net[min(p, q), max(p, q)] += 1 if p < q else -1
    return {k: v for k, v in net.items() if v}


def _sides(pieces: dict) -> list:
    """Pieces with no winding on one side and some on the other, directed so that some lies to the left."""
    out = []
    for (p, q), times in pieces.items():
        # windings that a ray from the piece's middle meets: to the east, or to the north from a level piece
        level = p[1] == q[1]
        along, across = (0, 1) if level else (1, 0)
        at, beyond = (p[along] + q[along]) / 2, (p[across] + q[across]) / 2
        winding = 0
        for (a, b), n in pieces.items():
            if (a, b) != (p, q) and (a[along] <= at) != (b[along] <= at) and a[across] + (at - a[along]) / (b[along] - a[along]) * (b[across] - a[across]) > beyond:
                winding += n if (b[along] > a[along]) != level else -n
        behind = winding + (times if (q[along] > p[along]) != level else -times)
        left, right = (winding, behind) if level or q[1] < p[1] else (behind, winding)
        if (left != 0) != (right != 0):
            out.append((p, q) if left else (q, p))
    return out


def _traced(sides: list) -> list:
    """Rings of directed sides; where rings touch, each keeps to its own inside."""
    ways: dict = {}
    for p, q in sides:
        ways.setdefault(p, []).append(q)
    rings = []
    while ways:
        start = at = min(ways)
        ring, before = [start], None
        while True:
            options = ways[at]
            if before is None or len(options) == 1:
                to = options[0]
            else:
                back = math.atan2(before[1] - at[1], before[0] - at[0])
                to = min(options, key=lambda o: (back - math.atan2(o[1] - at[1], o[0] - at[0])) % (2 * math.pi))
            options.remove(to)
            if not options:
                del ways[at]
            if to in ring:
                first = ring.index(to)
                rings.append(ring[first:] + [to])
                del ring[first + 1 :]
                before, at = (ring[-2] if len(ring) > 1 else None), to
                if at not in ways or at == start:
                    break
            else:
                ring.append(to)
                before, at = at, to
    return rings


def signed_area(ring: list) -> float:
    """Area within a closed ring, below 0 if it runs clockwise."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def valid_rings(ring: list) -> list:
    """Rings, as lists of (x, y), that bound what a ring winds round: outer ones counter-clockwise, holes clockwise, the largest first."""
    rings = [r for r in _traced(_sides(_pieces(ring))) if len(r) > 3]
    return sorted(rings, key=lambda r: (-abs(signed_area(r)), r))


def repaired(ring: str) -> Column:
    """The valid rings of a ring (array of lon, lat): what it winds round, once.

    Self-crossing rings are cut at their crossings; doubled points and
    spikes, which are run to and fro, go.  Outer rings run counter-clockwise
    and holes clockwise, the largest first; a ring without any area gives an
    empty array, null and one with places that are no numbers gives null.
    Each edge is compared with every other, so rings should have some
    thousand points at most.
    """
    def of_one(points) -> list | None:
        if points is None:
            return None
        xy = [(p["lon"], p["lat"]) for p in points]
        if any(v is None or not math.isfinite(v) for p in xy for v in p):
            return None
        return [[{"lon": x, "lat": y} for x, y in r] for r in valid_rings(xy)]

    @F.pandas_udf(RINGS)
    def of_each(rings: pd.Series) -> pd.Series:
        return rings.map(of_one)

    return of_each(ring)


def repair_rings(df: DataFrame, ring: str = "ring", out: str = "rings") -> DataFrame:
    """Adds the valid rings of a column of rings, in tasks of some thousand rings each."""
    return dealt(df, RINGS_PER_TASK).withColumn(out, repaired(ring))
