"""Queries on polygons of any outline: overlay, repair, clipping, unions, smallest rectangles and packing.

The tables hold no polygons, so boxes derived from them are slanted: (x, y) goes to (3x + y,
2y - x), whose determinant is 7. No edge stays parallel to an axis, and every area is seven
times that of the boxes, which SQL can tell.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from solarweave.operators import packing, polygons
from solarweave.operators.spatial import overlap_join
from solarweave.plans.detections import union_sql
from solarweave.plans.fixtures import fixture, fixture_sql

TIMES = 7


def _point(x, y):
    return F.struct((3.0 * x + y).alias("x"), (2.0 * y - x).alias("y"))


def slanted(x1="x1", y1="y1", x2="x2", y2="y2"):
    """Rings of a slanted box."""
    a, b, c, d = (F.col(v).cast("double") if isinstance(v, str) else v for v in (x1, y1, x2, y2))
    return F.array(F.array(_point(a, b), _point(c, b), _point(c, d), _point(a, d)))


def ring_repair(spark, sf_dir):
    """Parts and area of rings that cross themselves and each other: a slanted bow-tie, and a box over its lower half."""
    f = fixture(spark, sf_dir, "faces")
    w, h, o = F.col("w"), F.col("h"), F.lit(0.0)
    at = lambda x, y: _point(x + F.col("face_id") % 100, y)
    bow = F.array(at(o, o), at(w, h), at(o, h), at(w, o), at(o, o))
    box = F.array(at(o, o), at(o, h / 2), at(w, h / 2), at(w, o))
    out = f.select("face_id", polygons.repaired(F.when(F.col("face_id") % 3 == 0, F.array(bow)).otherwise(F.array(box, bow))).alias("parts"))
    return polygons.exploded(out).groupBy("face_id").agg(F.count("*").alias("parts"), F.round(F.sum("area"), 6).alias("area"))


def polygon_overlay(spark, sf_dir):
    """Areas of union, common part, difference and odd part of slanted boxes of one order and kind that overlap."""
    b = fixture(spark, sf_dir, "order_boxes").select("id", "analysis", "kind", "x1", "y1", "x2", "y2")
    met = overlap_join(b, b, 4.0, on=("analysis", "kind"), counted=True).filter("a_id < b_id")
    rings = lambda p: slanted(*(f"{p}{c}" for c in ("x1", "y1", "x2", "y2")))
    out = met.select("a_id", "b_id", rings("a_").alias("a"), rings("b_").alias("b"))
    out = out.select("a_id", "b_id", polygons.shared_areas(F.col("a"), F.col("b")).alias("of"), F.size(polygons.united(F.array("a", "b"))).alias("parts"))
    return out.select("a_id", "b_id", *(F.round(f"of.{c}", 6).alias(c) for c in ("whole", "both", "first", "either")), "parts")


def polygon_union_area(spark, sf_dir):
    """Area that an order's slanted boxes cover together."""
    b = fixture(spark, sf_dir, "order_boxes").select("analysis", slanted().alias("rings"))
    return polygons.union_area(b, "analysis", size=16.0).select("analysis", F.round("union_area", 6).alias("union_area"))


def polygon_clip(spark, sf_dir):
    """Slanted detections clipped to the roof of their analysis, slivers left out, and whether they block modules."""
    b = fixture(spark, sf_dir, "order_boxes")
    one, four = F.lit(1.0), F.lit(4.0)
    roofs = b.select("analysis").distinct().select("analysis", slanted(one, one, four, four).alias("rings"))
    met = polygons.clipped(b.select("id", "analysis", "kind", slanted().alias("rings")), roofs, 16.0, on=("analysis",), least=0.01 * TIMES)
    return met.select(F.col("a_id").alias("id"), F.round("area", 6).alias("area"), (F.col("a_kind") != "shadow").alias("blocks"))


def free_polygons(spark, sf_dir):
    """What the slanted detections of an analysis leave of its slanted roof, and in how many parts."""
    b = fixture(spark, sf_dir, "order_boxes")
    zero, four = F.lit(0.0), F.lit(4.0)
    roofs = b.select("analysis").distinct().select("analysis", slanted(zero, zero, four, four).alias("rings"))
    return polygons.free_parts(roofs, b.select("analysis", slanted().alias("rings")), "analysis", 16.0).select("analysis", F.round("area", 6).alias("area"))


def smallest_rectangles(spark, sf_dir):
    """Sides of the smallest rectangle around a quadrilateral of each part, at any angle."""
    f = fixture(spark, sf_dir, "faces")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    s = (F.col("face_id") % 7) / 4
    ring = F.array(p(F.lit(0), s), p(F.col("w"), s * 2), p(F.col("w") - s, F.col("h") + 2), p(s / 2, F.col("h")))
    r = f.select("face_id", polygons.smallest_rectangle(ring).alias("r"))
    return r.select("face_id", F.round(F.col("r.long") * F.col("r.short"), 6).alias("area"))


def _turned(x, y, degrees):
    """A point of a roof's plane on the map: x along the contour, y down the slope (in the plane), of a face of that azimuth."""
    a = F.radians(degrees)
    return F.struct((x * F.cos(a) + y * F.sin(a)).alias("x"), (y * F.cos(a) - x * F.sin(a)).alias("y"))


def polygon_packing(spark, sf_dir):
    """Modules of each face alone, an L in its plane at an azimuth off the axes, with an obstacle whose corners are turned likewise."""
    f = fixture(spark, sf_dir, "faces").filter("slope is not null and slope >= 1 and slope < 80").withColumn("azimuth", (F.col("face_id") * 37 % 360).cast("double"))
    c = F.cos(F.radians("slope"))
    at = lambda u, v: _turned(F.lit(float(u)) if isinstance(u, int | float) else u, (F.lit(float(v)) if isinstance(v, int | float) else v) * c, F.col("azimuth"))
    w, h = F.col("w"), F.col("h")
    outline = F.array(at(0, 0), at(w, 0), at(w, h / 2), at(w / 2, h / 2), at(w / 2, h), at(0, h))
    shut = F.array(at(1.5, 1.0), at(2.0, 1.0), at(2.0, 1.5), at(1.5, 1.5))
    faces = f.select(F.col("face_id").alias("building_id"), "face_id", "slope", "azimuth", F.array(outline).alias("rings"))
    out = packing.polygon_ledger(faces, f.filter("face_id % 2 = 0").select(F.col("face_id").alias("building_id"), F.array(shut).alias("rings")))
    return out.select("face_id", "panels", F.round("surface_area", 4).alias("surface_area"))


QUERIES = {f.__name__: f for f in (ring_repair, polygon_overlay, polygon_union_area, polygon_clip, free_polygons, smallest_rectangles, polygon_packing)}

_FREE = f"k AS (SELECT analysis, x1, y1, least(x2, 4) AS x2, least(y2, 4) AS y2 FROM ({fixture_sql('order_boxes')}))"
#: An L: its lower half is whole, its upper half as wide as half of it. A module keeps the setback from the outline; the notch and the obstacle are kept away by their distance.
_PACK = f"""
faces AS ({fixture_sql("faces")}),
ok AS (SELECT face_id, w, h, slope FROM faces WHERE slope IS NOT NULL AND slope >= 1 AND slope < 80),
room AS (SELECT *, w - 1.2::DOUBLE AS iu, h - 1.2::DOUBLE AS iv, w - 1.2::DOUBLE > 12 AND h - 1.2::DOUBLE > 6 AS gap FROM ok),
way(k, pw, ph) AS (VALUES (0, 1.134::DOUBLE, 1.762::DOUBLE), (1, 1.762::DOUBLE, 1.134::DOUBLE)), start(n, o) AS (VALUES (0, 0.0::DOUBLE), (1, 0.25::DOUBLE), (2, 0.5::DOUBLE), (3, 0.75::DOUBLE)),
steps AS (SELECT r.*, k * 16 + a.n * 4 + b.n AS i, pw, ph, a.o AS ox, b.o AS oy, pw + 0.1::DOUBLE AS sx, ph + CASE WHEN slope < 5 THEN 1.0 ELSE 0.35 END::DOUBLE AS sy FROM room r, way, start a, start b WHERE iu > 0 AND iv > 0),
spots AS (SELECT s.*, 0.6::DOUBLE + (ox + c) * sx AS x, 0.6::DOUBLE + (oy + d) * sy AS y FROM (SELECT *, unnest(range(0, greatest(ceil((iu - pw + 1e-8::DOUBLE - ox * sx) / sx), 0)::BIGINT)) AS c FROM steps) s, range(0, 40) AS t(d) WHERE d < ceil((iv - ph + 1e-8::DOUBLE - oy * sy) / sy)),
held AS (SELECT face_id, i, count(*) AS n FROM spots
  WHERE NOT (gap AND x < 0.6 + iu / 2 + 0.4::DOUBLE - 1e-8 AND x + pw > 0.6 + iu / 2 - 0.4::DOUBLE + 1e-8)
  AND pow(greatest(w / 2 - (x + pw), 0), 2) + pow(greatest(h / 2 - (y + ph), 0), 2) >= 0.36 - 1e-7
  AND (face_id % 2 <> 0 OR pow(greatest(1.5 - (x + pw), x - 2.0, 0), 2) + pow(greatest(1.0 - (y + ph), y - 1.5, 0), 2) >= 0.25 - 1e-7) GROUP BY face_id, i)"""
SQL = {
    "ring_repair": f"SELECT face_id, CASE WHEN face_id % 3 = 0 THEN 2 ELSE 3 END::BIGINT AS parts, round({TIMES} * w * h / 2, 6) AS area FROM ({fixture_sql('faces')})",
    "polygon_overlay": f"""WITH b AS ({fixture_sql("order_boxes")}), m AS (
  SELECT a.id AS a_id, b.id AS b_id, (a.x2 - a.x1) * (a.y2 - a.y1) AS p, (b.x2 - b.x1) * (b.y2 - b.y1) AS q, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS s
  FROM b a JOIN b ON a.analysis = b.analysis AND a.kind = b.kind AND a.id < b.id)
SELECT a_id, b_id, round({TIMES} * (p + q - s), 6) AS whole, round({TIMES} * s, 6) AS both, round({TIMES} * (p - s), 6) AS first, round({TIMES} * (p + q - 2 * s), 6) AS either, 1 AS parts FROM m WHERE s > 0""",
    "polygon_union_area": f"WITH b AS ({fixture_sql('order_boxes')}), {union_sql('b', 'analysis')} SELECT analysis, round({TIMES} * union_area, 6) AS union_area FROM covered",
    "polygon_clip": f"""SELECT id, round({TIMES} * (least(x2, 4.0) - greatest(x1, 1.0)) * (least(y2, 4.0) - greatest(y1, 1.0)), 6) AS area, kind <> 'shadow' AS blocks FROM ({fixture_sql("order_boxes")})
WHERE least(x2, 4.0) > greatest(x1, 1.0) AND least(y2, 4.0) > greatest(y1, 1.0) AND (least(x2, 4.0) - greatest(x1, 1.0)) * (least(y2, 4.0) - greatest(y1, 1.0)) > 0.01""",
    "free_polygons": f"WITH {_FREE}, {union_sql('k', 'analysis')} SELECT analysis, round({TIMES} * (16 - union_area), 6) AS area FROM covered",
    "smallest_rectangles": f"""WITH r AS (SELECT face_id, w, h, (face_id % 7)::DOUBLE / 4 AS s FROM ({fixture_sql("faces")})),
p AS (SELECT face_id, [{{'x': 0.0::DOUBLE, 'y': s}}, {{'x': w, 'y': s * 2}}, {{'x': w - s, 'y': h + 2}}, {{'x': s / 2, 'y': h}}] AS ps FROM r),
way AS (SELECT face_id, ps, ps[j].x - ps[i].x AS dx, ps[j].y - ps[i].y AS dy FROM p, (VALUES (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)) AS v(i, j)),
side AS (SELECT face_id, [(q.x * dx + q.y * dy) / sqrt(dx * dx + dy * dy) FOR q IN ps] AS a, [(q.y * dx - q.x * dy) / sqrt(dx * dx + dy * dy) FOR q IN ps] AS b FROM way)
SELECT face_id, round(min((list_max(a) - list_min(a)) * (list_max(b) - list_min(b))), 6) AS area FROM side GROUP BY face_id""",
    "polygon_packing": f"""WITH {_PACK}
SELECT face_id, coalesce((SELECT max(n) FROM held h WHERE h.face_id = o.face_id), 0)::BIGINT AS panels, round(w * h * 0.75, 4) AS surface_area FROM ok o""",
}
