"""Axis-parallel boxes as four columns x1, y1, x2, y2, and polygons as arrays of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(a: str = "") -> Column:
    return (F.col(f"{a}x2") - F.col(f"{a}x1")) * (F.col(f"{a}y2") - F.col(f"{a}y1"))


def overlap(a: str, b: str) -> Column:
    """Area that two boxes share; prefixes name their columns."""
    side = lambda k: F.greatest(F.least(f"{a}{k}2", f"{b}{k}2") - F.greatest(f"{a}{k}1", f"{b}{k}1"), F.lit(0.0))
    return side("x") * side("y")


def gap_squared(a: str, b: str) -> Column:
    """Square of the distance of two boxes, 0 where they meet."""
    side = lambda k: F.greatest(F.col(f"{a}{k}1") - F.col(f"{b}{k}2"), F.col(f"{b}{k}1") - F.col(f"{a}{k}2"), F.lit(0.0))
    return side("x") * side("x") + side("y") * side("y")


def covers(a: str, b: str) -> Column:
    """Whether the first box holds all of the second."""
    return (F.col(f"{a}x1") <= F.col(f"{b}x1")) & (F.col(f"{a}y1") <= F.col(f"{b}y1")) & (F.col(f"{a}x2") >= F.col(f"{b}x2")) & (F.col(f"{a}y2") >= F.col(f"{b}y2"))


def ring_area(ring: Column) -> Column:
    """Unsigned area of a ring of structs x, y by the shoelace formula; the ring need not be closed."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, i.cast("int"))
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: at(i)["x"] * at(i % n + 1)["y"] - at(i % n + 1)["x"] * at(i)["y"])
    return F.when(n >= 3, F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2).otherwise(F.lit(0.0))


def ring_bounds(ring: Column) -> Column:
    """Struct x1, y1, x2, y2 of a ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def ring_centroid(ring: Column) -> Column:
    """Struct x, y of the centroid of a ring's area; null where it covers nothing."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, i.cast("int"))
    total = lambda f: F.aggregate(F.transform(F.sequence(F.lit(1), n), lambda i: f(at(i), at(i % n + 1))), F.lit(0.0), lambda s, t: s + t)
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    twice = total(cross)
    return F.when((n >= 3) & (twice != 0), F.struct(*((total(lambda p, q, k=k: (p[k] + q[k]) * cross(p, q)) / (3 * twice)).alias(k) for k in ("x", "y"))))


def ring_distance(ring: Column, x: Column, y: Column) -> Column:
    """Distance of a point from the nearest edge of a ring; a ring of one point is that point."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, i.cast("int"))

    def edge(i):
        p, q = at(i), at(i % n + 1)
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide((x - p["x"]) * dx + (y - p["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        return F.hypot(x - p["x"] - t * dx, y - p["y"] - t * dy)

    return F.when(n > 0, F.array_min(F.transform(F.sequence(F.lit(1), n), edge)))


def plane_azimuth(slope: Column, azimuth: Column, w: Column, h: Column) -> Column:
    """Azimuth of a face's plane: its own, or under one degree of slope that which lays its longer side along the contour."""
    return F.when(slope < 1, F.when(w >= h, 0.0).otherwise(90.0)).otherwise(azimuth)


def to_plane(x: Column, y: Column, slope: Column, azimuth: Column) -> Column:
    """Struct u, v: along the contour, and down the slope stretched by 1 / cos(slope)."""
    a, c = F.radians(azimuth), F.cos(F.radians(slope))
    return F.struct((x * F.cos(a) - y * F.sin(a)).alias("u"), ((x * F.sin(a) + y * F.cos(a)) / c).alias("v"))


def from_plane(u: Column, v: Column, slope: Column, azimuth: Column) -> Column:
    """Struct x, y: the inverse of to_plane."""
    a, w = F.radians(azimuth), v * F.cos(F.radians(slope))
    return F.struct((u * F.cos(a) + w * F.sin(a)).alias("x"), (w * F.cos(a) - u * F.sin(a)).alias("y"))


def pixel_to_world(px: Column, py: Column, bounds: tuple[Column, Column, Column, Column], width: Column, height: Column, off_x: Column, off_y: Column) -> Column:
    """Struct x, y of a pixel of a crop: bounds are left, bottom, right, top of the whole image; kept inside them."""
    left, bottom, right, top = bounds
    x = left + (px + off_x) * (right - left) / width
    y = top - (py + off_y) * (top - bottom) / height
    return F.struct(F.greatest(left, F.least(right, x)).alias("x"), F.greatest(bottom, F.least(top, y)).alias("y"))


def lv95_to_wgs84(east: Column, north: Column) -> Column:
    """Struct lon, lat in degrees by swisstopo's published approximate series, good to about a metre."""
    y, x = (east - 2600000) / 1000000, (north - 1200000) / 1000000
    lon = 2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y * y * y
    lat = 16.9023892 + 3.238272 * x - 0.270978 * y * y - 0.002528 * x * x - 0.0447 * y * y * x - 0.0140 * x * x * x
    return F.struct((lon * 100 / 36).alias("lon"), (lat * 100 / 36).alias("lat"))


def wgs84_to_utm32(lon: Column, lat: Column) -> Column:
    """Struct east, north in UTM zone 32 (EPSG:25832) by the published series, good to a centimetre within the zone."""
    a, e = 6378137.0, 0.00669437999014132
    e2, f, diff = e / (1 - e), F.radians(lat), F.radians(lon - 9)
    n, t, c, b = a / F.sqrt(1 - e * F.pow(F.sin(f), 2)), F.pow(F.tan(f), 2), e2 * F.pow(F.cos(f), 2), F.cos(f) * diff
    arc = (1 - e / 4 - 3 * e**2 / 64 - 5 * e**3 / 256) * f - (3 * e / 8 + 3 * e**2 / 32 + 45 * e**3 / 1024) * F.sin(2 * f) + (15 * e**2 / 256 + 45 * e**3 / 1024) * F.sin(4 * f) - (35 * e**3 / 3072) * F.sin(6 * f)
    east = 500000 + 0.9996 * n * (b + (1 - t + c) * F.pow(b, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * e2) * F.pow(b, 5) / 120)
    north = 0.9996 * (a * arc + n * F.tan(f) * (b * b / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(b, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * e2) * F.pow(b, 6) / 720))
    return F.struct(east.alias("east"), north.alias("north"))


def wgs84_to_lv95(lon: Column, lat: Column) -> Column:
    """Struct east, north by swisstopo's published approximate series, good to about a metre."""
    f, g = (lat * 3600 - 169028.66) / 10000, (lon * 3600 - 26782.5) / 10000
    east = 2600072.37 + 211455.93 * g - 10938.51 * g * f - 0.36 * g * f * f - 44.54 * g * g * g
    north = 1200147.07 + 308807.95 * f + 3745.25 * g * g + 76.63 * f * f - 194.56 * g * g * f + 119.79 * f * f * f
    return F.struct(east.alias("east"), north.alias("north"))
