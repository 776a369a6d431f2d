"""Points, pixels of the equirectangular grid, and polygon rings as arrays of [x, y]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0
WIDTH, HEIGHT = 4320, 2160


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in km."""
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), F.lit(2.0)) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lng2) - F.radians(lng1)) / 2), F.lit(2.0))
    return 2 * RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def pixel(lat: Column, lng: Column, width: int = WIDTH, height: int = HEIGHT) -> Column:
    """[x, y] of a point, y from the top."""
    return F.array(F.floor((lng + 180) / 360 * width).cast("int"), (F.lit(height) - F.floor((lat + 90) / 180 * height)).cast("int"))


def pixel_centre(x: Column, y: Column, width: int = WIDTH, height: int = HEIGHT) -> Column:
    """[lng, lat] of a pixel."""
    return F.array(x / width * 360 - 180, F.lit(90.0) - y / height * 180)


def cell_index(x: Column, y: Column, width: int = WIDTH) -> Column:
    return (y * width + x).cast("bigint")


def offset(lat: Column, lng: Column, east_m: Column, north_m: Column) -> Column:
    """[lat, lng] moved by metres."""
    north = F.degrees(north_m / (RADIUS_KM * 1000))
    return F.array(lat + north, lng + F.degrees(east_m / (RADIUS_KM * 1000 * F.cos(F.radians(lat)))))


def _edges(ring: Column) -> Column:
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(F.get(a, F.lit(0)).alias("x0"), F.get(a, F.lit(1)).alias("y0"), F.get(b, F.lit(0)).alias("x1"), F.get(b, F.lit(1)).alias("y1")))


def _sum(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, e: s + f(e))


def signed_area(ring: Column) -> Column:
    return _sum(_edges(ring), lambda e: e["x0"] * e["y1"] - e["x1"] * e["y0"]) / 2


def centroid(ring: Column) -> Column:
    """Area-weighted centroid [x, y] of a ring."""
    cross = lambda e: e["x0"] * e["y1"] - e["x1"] * e["y0"]
    a6 = signed_area(ring) * 6
    return F.array(F.try_divide(_sum(_edges(ring), lambda e: (e["x0"] + e["x1"]) * cross(e)), a6), F.try_divide(_sum(_edges(ring), lambda e: (e["y0"] + e["y1"]) * cross(e)), a6))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule by ray casting."""
    crosses = lambda e: ((e["y0"] > y) != (e["y1"] > y)) & (x < (e["x1"] - e["x0"]) * F.try_divide(y - e["y0"], e["y1"] - e["y0"]) + e["x0"])
    return F.size(F.filter(_edges(ring), crosses)) % 2 == 1


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: F.get(p, F.lit(0))), F.transform(ring, lambda p: F.get(p, F.lit(1)))
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def centre(ring: Column) -> Column:
    b = bounds(ring)
    return F.array((b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2)


def truncated(ring: Column, places: int = 6) -> Column:
    return F.transform(ring, lambda p: F.transform(p, lambda v: F.round(v, places)))


def shape_key(ring: Column, places: int = 6) -> Column:
    """A key that equal shapes share."""
    return F.sha2(F.to_json(truncated(ring, places)), 256)


def geodesic_area(ring: Column) -> Column:
    """m^2 on the sphere of a ring of [lng, lat]."""
    r = RADIUS_KM * 1000
    term = lambda e: (F.radians(e["x1"]) - F.radians(e["x0"])) * (2 + F.sin(F.radians(e["y0"])) + F.sin(F.radians(e["y1"])))
    return F.abs(_sum(_edges(ring), term) * r * r / 2)


def rectangle(x0: Column, y0: Column, w: Column, h: Column) -> Column:
    d = lambda c: c.cast("double")
    return F.array(F.array(d(x0), d(y0)), F.array(d(x0 + w), d(y0)), F.array(d(x0 + w), d(y0 + h)), F.array(d(x0), d(y0 + h)))


def geometry_order(kind: Column) -> Column:
    """Polygons, then lines, then points."""
    return F.when(kind.contains("Polygon"), 0).when(kind.contains("Line"), 1).otherwise(2)
