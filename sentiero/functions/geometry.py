"""Plane geometry on rings (array<struct<x,y>>, closed implicitly) as column expressions, and map projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _edges(ring: Column) -> Column:
    """Structs (a, b) of the ring's edges, the last back to the first corner."""
    moved = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, moved, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive counter-clockwise."""
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def centroid(ring: Column) -> Column:
    """Centre of mass; the mean of the corners where the area is 0."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    sx = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] + e["b"]["x"]) * cross(e))
    sy = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["y"] + e["b"]["y"]) * cross(e))
    a6 = 6 * signed_area(ring)
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[c]) / F.size(ring)
    return point(F.when(a6 != 0, sx / a6).otherwise(mean("x")), F.when(a6 != 0, sy / a6).otherwise(mean("y")))


def inner_point(ring: Column) -> Column:
    """A point surely inside the ring: the middle of the widest stretch that a level line near mid-height has in it.

    The level lies half-way between the corner heights next to the middle, so it meets no corner. Null for a ring without
    height.
    """
    ys = F.array_sort(F.array_distinct(F.transform(ring, lambda p: p["y"])))
    middle = (F.array_min(ys) + F.array_max(ys)) / 2
    level = (F.array_max(F.filter(ys, lambda y: y <= middle)) + F.array_min(F.filter(ys, lambda y: y > middle))) / 2
    crossing = F.filter(_edges(ring), lambda e: (e["a"]["y"] > level) != (e["b"]["y"] > level))
    xs = F.array_sort(F.transform(crossing, lambda e: e["a"]["x"] + (level - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])))
    stretches = F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(2)), lambda i: F.struct((F.get(xs, i) - F.get(xs, i - 1)).alias("w"), ((F.get(xs, i) + F.get(xs, i - 1)) / 2).alias("x")))
    return F.when(F.size(xs) >= 2, point(F.array_max(stretches)["x"], level))


def bounds(ring: Column) -> Column:
    """Struct (x0, y0, x1, y1)."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def on_border(x: Column, y: Column, ring: Column) -> Column:
    """Whether the point lies on an edge."""

    def touches(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((bx - ax) * (y - ay) == (by - ay) * (x - ax)) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))

    return F.exists(_edges(ring), touches)


def covers(ring: Column, x: Column, y: Column) -> Column:
    """Whether the point is inside the ring or on its border."""

    def crossed(s: Column, e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        spans = (ay > y) != (by > y)
        return s + F.when(spans & (x < (bx - ax) * (y - ay) / F.when(by != ay, by - ay).otherwise(F.lit(1.0)) + ax), 1).otherwise(0)

    return on_border(x, y, ring) | (F.aggregate(_edges(ring), F.lit(0), crossed) % 2 == 1)


def within(ring: Column, x: Column, y: Column) -> Column:
    """Whether the point is inside the ring; its border is outside."""
    return covers(ring, x, y) & ~on_border(x, y, ring)


def _segment_distance(x: Column, y: Column, e: Column) -> Column:
    ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / n))).otherwise(0.0)
    return F.hypot(x - ax - t * dx, y - ay - t * dy)


def distance_to(ring: Column, x: Column, y: Column) -> Column:
    """Distance from the point to the region, 0 inside: membership in a buffer is a distance up to its width."""
    return F.when(covers(ring, x, y), 0.0).otherwise(F.array_min(F.transform(_edges(ring), lambda e: _segment_distance(x, y, e))))


def _side(a: Column, b: Column, p: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))


def line_meets(line: Column, ring: Column) -> Column:
    """Whether a line (array of points) has a point in common with the region."""
    pieces = F.zip_with(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def cut(p: Column, e: Column) -> Column:
        return (_side(p["a"], p["b"], e["a"]) * _side(p["a"], p["b"], e["b"]) <= 0) & (_side(e["a"], e["b"], p["a"]) * _side(e["a"], e["b"], p["b"]) < 0)

    return F.exists(line, lambda p: covers(ring, p["x"], p["y"])) | F.exists(pieces, lambda p: F.exists(_edges(ring), lambda e: cut(p, e)))


def line_length(line: Column) -> Column:
    steps = F.zip_with(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)


#: The GRS80 ellipsoid and the scale and false easting of the metric zones.
_A, _F, _K0, _FE = 6378137.0, 1 / 298.257222101, 0.9996, 500_000.0
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_metric(lat: Column, lon: Column, central_meridian: float = 9.0) -> Column:
    """Struct (x, y) in the transverse Mercator zone of ``central_meridian``, by Krueger's series of third order."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lon - central_meridian)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_ALPHA[1:], 2)), _ALPHA[0] * F.cos(2 * xi) * F.sinh(2 * eta))
    y = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_ALPHA[1:], 2)), _ALPHA[0] * F.sin(2 * xi) * F.cosh(2 * eta))
    return point(_FE + _K0 * _RADIUS * x, _K0 * _RADIUS * y)


def to_degrees(x: Column, y: Column, central_meridian: float = 9.0) -> Column:
    """Struct (lat, lon) of a position in the metric zone."""
    xi, eta = y / (_K0 * _RADIUS), (x - _FE) / (_K0 * _RADIUS)
    xi1 = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(_BETA[1:], 2)), _BETA[0] * F.sin(2 * xi) * F.cosh(2 * eta))
    eta1 = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(_BETA[1:], 2)), _BETA[0] * F.cos(2 * xi) * F.sinh(2 * eta))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(_DELTA[1:], 2)), _DELTA[0] * F.sin(2 * chi))
    lam = F.atan2(F.sinh(eta1), F.cos(xi1))
    return F.struct(F.degrees(phi).alias("lat"), (F.degrees(lam) + central_meridian).alias("lon"))


def covering_circles(south: float, north: float, west: float, east: float, radius_m: float):
    """Row and column counts and steps (rows, columns, dlat, dlon) of staggered circles that cover a box."""
    dlat = radius_m * 1.5 / 111_320.0
    dlon = radius_m * math.sqrt(3) / (111_320.0 * math.cos(math.radians((south + north) / 2)))
    return max(1, math.ceil((north - south) / dlat) + 1), max(1, math.ceil((east - west) / dlon) + 2), dlat, dlon


def covering_grid(spark, south: float, north: float, west: float, east: float, radius_m: float):
    """(lat, lon) centres of staggered circles of ``radius_m`` that cover a box."""
    rows, columns, dlat, dlon = covering_circles(south, north, west, east, radius_m)
    grid = spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("r"), (F.col("id") % columns).alias("c"))
    shift = F.when(F.col("r") % 2 == 1, 0.5).otherwise(0.0)
    return grid.select((F.lit(south) + F.col("r") * dlat).alias("lat"), (F.lit(west) + (F.col("c") - shift) * dlon).alias("lon"))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise from the leftmost; collinear points left out."""
    p = sorted(set(points))
    if len(p) < 3:
        return p
    half = []
    for way in (p, p[::-1]):
        chain: list[tuple[float, float]] = []
        for q in way:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (q[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (q[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(q)
        half.append(chain[:-1])
    return half[0] + half[1]


def convex_hulls(points, key: str):
    """(key, hull): convex hull of the points (key, x, y) of each key.

    Hulls of blocks come first and the hull of their corners after, so no key's points meet in one task.
    """
    import pandas as pd

    kind = points.schema[key].dataType.simpleString()

    def of(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(g[key].iloc[0], x, y) for x, y in hull(list(zip(g["x"], g["y"], strict=True)))], columns=[key, "x", "y"])

    blocks = points.select(key, F.col("x").cast("double"), F.col("y").cast("double")).withColumn("b", F.pmod(F.xxhash64("x", "y"), F.lit(64)))
    corners = blocks.groupBy(key, "b").applyInPandas(of, f"{key} {kind}, x double, y double")

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [g[key].iloc[0]], "hull": [[{"x": x, "y": y} for x, y in hull(list(zip(g["x"], g["y"], strict=True)))]]})

    return corners.groupBy(key).applyInPandas(whole, f"{key} {kind}, hull array<struct<x:double,y:double>>")


def is_simple_ring(ring: Column) -> Column:
    """Whether a ring has three different corners and area and none of its edges cross: others are set aside for repair."""
    e = _edges(ring)
    crossing = F.exists(e, lambda p: F.exists(e, lambda q: (_side(p["a"], p["b"], q["a"]) * _side(p["a"], p["b"], q["b"]) < 0) & (_side(q["a"], q["b"], p["a"]) * _side(q["a"], q["b"], p["b"]) < 0)))
    return (F.size(F.array_distinct(ring)) >= 3) & (signed_area(ring) != 0) & ~crossing
