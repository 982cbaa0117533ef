"""Queries on faces, layouts, roof parts and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from solarweave.functions import boxes
from solarweave.operators import layout, packing, roofs
from solarweave.operators.spatial import apart_from, overlap_join
from solarweave.plans.fixtures import fixture, fixture_sql


def layout_totals(spark, sf_dir):
    """Panels, capacity and energy of each building: the best of 32 layouts on every face."""
    faces = fixture(spark, sf_dir, "faces").filter(layout.usable_face(F.col("slope"), F.col("aspect")))
    out = layout.building_totals(layout.best_layouts(faces))
    return out.select("building_id", "facets", "panel_count", F.round("kwp", 2).alias("kwp"), F.round("usable_area", 4).alias("usable_area"), F.round("annual_kwh", 3).alias("annual_kwh"))


def face_layouts(spark, sf_dir):
    """Each face's panels and the layout that holds most, the first of equals."""
    faces = fixture(spark, sf_dir, "faces").filter(layout.usable_face(F.col("slope"), F.col("aspect")))
    return layout.best_layouts(faces).select("face_id", "panel_count", F.when(F.col("panel_count") > 0, F.col("layout")).alias("layout"), F.round("surface_area", 4).alias("surface_area"))


_LAYOUT = f"""
faces AS ({fixture_sql("faces")}),
ok AS (SELECT * FROM faces WHERE slope IS NOT NULL AND aspect IS NOT NULL AND slope >= 0 AND slope < 80),
plane AS (SELECT *, CASE WHEN aspect % 180 = 0 THEN w ELSE h END AS u, (CASE WHEN aspect % 180 = 0 THEN h ELSE w END) / cos(radians(slope)) AS v FROM ok),
inner_ AS (SELECT *, greatest(u - 1.2::DOUBLE, 0) AS iu, greatest(v - 1.2::DOUBLE, 0) AS iv FROM plane),
split AS (SELECT *, iu > 12 AND iv > 6 AS gap, w * h >= 1 AND iu > 0 AND iv > 0 AS fits FROM inner_),
sides(k, pw, ph) AS (VALUES (0, 1.134::DOUBLE, 1.762::DOUBLE), (1, 1.762::DOUBLE, 1.134::DOUBLE)),
origins(o, f) AS (VALUES (0, 0.0::DOUBLE), (1, 0.25::DOUBLE), (2, 0.5::DOUBLE), (3, 0.75::DOUBLE)),
layouts AS (SELECT 16 * k + 4 * x.o + y.o AS i, pw, ph, x.f AS ox, y.f AS oy FROM sides, origins x, origins y),
steps AS (SELECT s.*, l.*, pw + 0.1::DOUBLE AS sx, ph + CASE WHEN slope < 5 THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END AS sy FROM split s, layouts l),
places AS (SELECT *, floor((iu - pw + 1e-8::DOUBLE - sx * ox) / sx + 1 - 1e-12::DOUBLE)::BIGINT AS nx, floor((iv - ph + 1e-8::DOUBLE - sy * oy) / sy + 1 - 1e-12::DOUBLE)::BIGINT AS ny FROM steps),
counts AS (SELECT *, CASE WHEN NOT fits THEN 0 ELSE greatest(ny, 0) * CASE WHEN nx <= 0 THEN 0 WHEN NOT gap THEN nx
  ELSE len(list_filter(range(0, nx), lambda j: NOT (sx * ox + j * sx + pw > iu / 2 - 0.4::DOUBLE AND sx * ox + j * sx < iu / 2 + 0.4::DOUBLE))) END END AS n FROM places),
best AS (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY n DESC, i) AS place FROM counts),
done AS (SELECT *, CASE WHEN NOT fits THEN 0 ELSE iu * iv - CASE WHEN gap THEN 0.8::DOUBLE * iv ELSE 0 END END AS usable, n * 450 / 1000.0::DOUBLE * irradiance * 0.8::DOUBLE AS kwh FROM best WHERE place = 1)"""


def energy_null_propagation(spark, sf_dir):
    """Energy of an order's lines as facets: unknown for the whole where one is unknown."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    faces = lines.select(F.col("l_orderkey").alias("building_id"), F.col("l_quantity").cast("long").alias("panel_count"), F.lit(0.0).alias("usable_area"), F.when(F.col("l_partkey") % 10 != 0, 900.0 + F.col("l_suppkey") % 300).alias("irradiance"))
    return layout.building_totals(faces).select("building_id", "facets", "panel_count", F.round("annual_kwh", 3).alias("annual_kwh"))


def facet_validity(spark, sf_dir):
    """Which faces are planned, and their azimuth."""
    faces = fixture(spark, sf_dir, "faces")
    return faces.select("face_id", layout.usable_face(F.col("slope"), F.col("aspect")).alias("planned"), layout.azimuth(F.col("aspect")).alias("azimuth"))


def _panels(faces):
    """Panels on a grid of 2 m that a face's box, drawn in by 0.5 m, covers: as many as its sides allow."""
    steps = lambda side: F.explode(F.sequence(F.lit(0), F.ceil(F.col(side) / 2).cast("int")))
    grid = faces.select("face_id", "w", "h", steps("w").alias("i")).select("*", steps("h").alias("j"))
    x, y = 0.5 + F.col("i") * 2.0, 0.5 + F.col("j") * 2.0
    own = grid.select("face_id", "i", "j", x.alias("x1"), y.alias("y1"), (x + 1.125).alias("x2"), (y + 1.75).alias("y2"), F.lit(0.5).alias("in_x1"), F.lit(0.5).alias("in_y1"), (F.col("w") - 0.5).alias("in_x2"), (F.col("h") - 0.5).alias("in_y2"))
    return own.filter(boxes.covers("in_", "")).drop("in_x1", "in_y1", "in_x2", "in_y2")


def covered_panels(spark, sf_dir):
    """Panels of a grid that the usable region of their face covers, counted."""
    return _panels(fixture(spark, sf_dir, "faces")).groupBy("face_id").agg(F.count("*").alias("n"), F.max("x2").alias("right"), F.max("y2").alias("top"))


def _placed_panels(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_linenumber = 1")
    x, y = (F.col("l_orderkey") % 32) * 0.75, (F.col("l_suppkey") % 16) * 1.0
    return lines.select(F.col("l_partkey").alias("face_id"), x.alias("x1"), y.alias("y1"), (x + 1.125).alias("x2"), (y + 1.75).alias("y2"))


def placed_panel_antijoin(spark, sf_dir):
    """Panels of a grid that share no area with any that is placed on their face already."""
    panels = _panels(fixture(spark, sf_dir, "faces"))
    return apart_from(panels, _placed_panels(spark, sf_dir), 4.0, 2.0, on=("face_id",), least=1e-8).select("face_id", "i", "j")


def planning_roof(spark, sf_dir):
    """Area of each face to plan on: what the detected roof shares with it, nothing where none was detected, all where no model is ready."""
    f = fixture(spark, sf_dir, "faces").select("face_id", "w", "h", F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("w").alias("x2"), F.col("h").alias("y2"))
    roof = fixture(spark, sf_dir, "faces").filter("face_id % 3 <> 0").select("face_id", F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"), F.lit(9.0).alias("x2"), F.lit(9.0).alias("y2"))
    met = overlap_join(f, roof, 16.0, on=("face_id",)).groupBy(F.col("a_face_id").alias("face_id")).agg(F.sum("overlap").alias("seen"))
    return f.join(met, "face_id", "left").select("face_id", roofs.planning_area(F.col("w") * F.col("h"), F.col("seen"), F.col("face_id") % 5 != 0).alias("area"))


def _face_obstacles(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x, y = 2.0 + F.col("l_linenumber") % 3, 1.5 + (F.col("l_suppkey") % 2) * 0.5
    return lines.select(F.col("l_partkey").alias("face_id"), x.alias("x1"), y.alias("y1"), (x + 0.5).alias("x2"), (y + 0.5).alias("y2")).distinct()


def obstacle_layouts(spark, sf_dir):
    """Modules and usable area of each face alone, with obstacles and an aisle."""
    f = fixture(spark, sf_dir, "faces").filter(layout.usable_face(F.col("slope"), F.col("aspect")))
    faces = layout.checked_faces(f).select(F.col("face_id").alias("building_id"), "face_id", "slope", "aspect", F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("w").alias("x2"), F.col("h").alias("y2"))
    out = packing.ledger(faces, _face_obstacles(spark, sf_dir).withColumnRenamed("face_id", "building_id"))
    return out.select("face_id", "panels", F.round("usable_area", 4).alias("usable_area"), F.round("surface_area", 4).alias("surface_area"))


def roof_neighbours(spark, sf_dir):
    """Parts within 20 m of every fiftieth part, where its register number is known; itself else."""
    parts = fixture(spark, sf_dir, "parts")
    spread = parts.select("id", "egid", *((F.col(c) + (F.col("id") % (1000 if c[0] == "x" else 777)) * 16).alias(c) for c in ("x1", "y1", "x2", "y2")))
    return roofs.neighbours(spread.filter("id % 50 = 0").withColumn("request", F.col("id") * 10), spread, 20.0, 32.0)


def building_selection(spark, sf_dir):
    """Records by building where that search found some and all have rings; else the record at the point."""
    f = fixture(spark, sf_dir, "faces")
    rings = F.when(F.col("face_id") % 11 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    by_key = f.select(F.col("building_id").alias("request"), F.col("face_id").alias("id"), rings.alias("rings")).filter("request % 7 <> 0")
    by_point = f.filter("face_id % 4 = 0").select(F.col("building_id").alias("request"), F.col("face_id").alias("id"), rings.alias("rings"))
    return roofs.selection(by_point, by_key).select("request", "id")


def roof_plane(spark, sf_dir):
    """A face's corner in the plane of its roof, and back; a face under one degree turns by its longest side."""
    f = fixture(spark, sf_dir, "faces").filter("slope is not null and aspect is not null and slope < 80")
    slope = F.when(F.col("face_id") % 6 == 0, 0.5).otherwise(F.col("slope"))
    turned = boxes.plane_azimuth(slope, layout.azimuth(F.col("aspect")), F.col("w"), F.col("h"))
    p = f.withColumn("s", slope).withColumn("a", turned).withColumn("p", boxes.to_plane(F.col("w"), F.col("h"), F.col("s"), F.col("a")))
    back = boxes.from_plane(F.col("p.u"), F.col("p.v"), F.col("s"), F.col("a"))
    return p.withColumn("b", back).select("face_id", F.round("p.u", 6).alias("u"), F.round("p.v", 6).alias("v"), (F.hypot(F.col("b.x") - F.col("w"), F.col("b.y") - F.col("h")) < 1e-9).alias("same"))


def ring_measures(spark, sf_dir):
    """Centroid of each ring, and its distance from the next one's bounds."""
    r = _rings(spark, sf_dir).withColumn("m", boxes.ring_centroid(F.col("ring")))
    far = boxes.ring_distance(F.col("ring"), F.col("w") + 3.0, F.col("h") + 4.0)
    return r.select("face_id", F.round("m.x", 9).alias("x"), F.round("m.y", 9).alias("y"), F.round(far, 9).alias("far"))


def utm_coordinates(spark, sf_dir):
    """Degrees to UTM zone 32 by the usual series of the transverse Mercator projection."""
    c = fixture(spark, sf_dir, "chips").select("id", (9.0 + (F.col("x") - 5000) / 5000).alias("lon"), (47.0 + F.col("y") / 10000).alias("lat"))
    return c.withColumn("u", boxes.wgs84_to_utm32(F.col("lon"), F.col("lat"))).select("id", F.round("u.east", 3).alias("east"), F.round("u.north", 3).alias("north"))


def panel_clearance_antijoin(spark, sf_dir):
    """Panels of a grid on each face that no obstacle comes nearer to than 0.5 m."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x, y = F.col("l_linenumber") * 1.5 + (F.col("l_orderkey") % 8) * 0.5, (F.col("l_suppkey") % 9) * 1.0
    obstacles = lines.select(F.col("l_partkey").alias("face_id"), x.alias("x1"), y.alias("y1"), (x + 0.5).alias("x2"), (y + 0.75).alias("y2"))
    return layout.clear_panels(_panels(fixture(spark, sf_dir, "faces")), obstacles, "face_id").select("face_id", "i", "j", "x1", "y1")


def image_window(spark, sf_dir):
    """Side and pixels of the image that a roof's extent asks for; null where it is too large."""
    w = fixture(spark, sf_dir, "windows").withColumn("win", layout.image_window(F.col("extent")))
    return w.select("id", "win.side", "win.pixels", F.format_string("%.3f", F.col("extent") / 8).alias("bound"))


def tile_grid(spark, sf_dir):
    """Crops of an image: starts of tiles of 512 and of 1000 pixels in both directions."""
    w = fixture(spark, sf_dir, "windows")
    cut = lambda t: w.withColumn("x0", F.explode(layout.tile_starts(F.col("px_w"), t))).withColumn("y0", F.explode(layout.tile_starts(F.col("px_h"), t))).select("id", F.lit(t).alias("tile"), "x0", "y0")
    return cut(512).union(cut(1000))


def _rings(spark, sf_dir):
    """A quadrilateral for each part, with corners off the grid of its box."""
    f = fixture(spark, sf_dir, "faces")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    s = (F.col("face_id") % 4) / 4
    return f.select("face_id", "w", "h", F.array(p(F.lit(0), F.lit(0) + s), p(F.col("w"), F.lit(0)), p(F.col("w") - s, F.col("h")), p(s, F.col("h") + s)).alias("ring"))


def polygon_area_shoelace(spark, sf_dir):
    """Area and bounds of a ring."""
    r = _rings(spark, sf_dir).withColumn("b", boxes.ring_bounds(F.col("ring")))
    return r.select("face_id", boxes.ring_area(F.col("ring")).alias("area"), F.col("b.x1").alias("min_x"), F.col("b.y2").alias("max_y"))


def pixel_world_affine(spark, sf_dir):
    """A pixel of a crop in metres, kept inside the image's bounds."""
    w = fixture(spark, sf_dir, "windows")
    bounds = (F.lit(2640000.0), F.lit(1230000.0), F.lit(2640128.0), F.lit(1230064.0))
    at = boxes.pixel_to_world(F.col("px_w").cast("double"), F.col("px_h").cast("double"), bounds, F.lit(1024.0), F.lit(512.0), F.lit(200.0), F.lit(100.0))
    return w.withColumn("p", at).select("id", "p.x", "p.y")


def connected_parts(spark, sf_dir):
    """The house of each roof part: parts of one register number within 1.5 m, over any number of steps."""
    return roofs.touching_parts(fixture(spark, sf_dir, "parts")).select("id", "egid", "house")


def grown_parts(spark, sf_dir):
    """Parts that grow from the first of each house, within the greatest extent."""
    return roofs.grown_selection(fixture(spark, sf_dir, "parts"))


def alignment_gates(spark, sf_dir):
    """Why a roof's shift to the image is applied or not."""
    s = fixture(spark, sf_dir, "scores")
    return s.select("id", roofs.alignment_reason(*(F.col(c) for c in ("best", "base", "rival", "shift", "support"))).alias("reason"))


def building_ledger(spark, sf_dir):
    """Faces of a building packed in order, with obstacles; earlier faces and panels keep later ones away."""
    f = fixture(spark, sf_dir, "faces").filter(layout.usable_face(F.col("slope"), F.col("aspect")))
    x, y = (F.col("face_id") % 7) * 3.0, (F.col("face_id") % 5) * 2.0
    faces = f.select("building_id", "face_id", "slope", "aspect", x.alias("x1"), y.alias("y1"), (x + F.col("w")).alias("x2"), (y + F.col("h")).alias("y2"))
    obstacles = _face_obstacles(spark, sf_dir).withColumn("building_id", F.floor(F.col("face_id") / 4).cast("long"))
    return packing.ledger(faces, obstacles)


def crs_round_trip(spark, sf_dir):
    """Survey coordinates to degrees and back, by published series, to the metre."""
    c = fixture(spark, sf_dir, "chips").select("id", (2600000 + F.col("x")).alias("e"), (1200000 + F.col("y")).alias("n"))
    d = c.withColumn("d", boxes.lv95_to_wgs84(F.col("e"), F.col("n")))
    back = boxes.wgs84_to_lv95(F.col("d.lon"), F.col("d.lat"))
    return d.withColumn("b", back).select("id", F.round("d.lon", 7).alias("lon"), F.round("d.lat", 7).alias("lat"), (F.hypot(F.col("b.east") - F.col("e"), F.col("b.north") - F.col("n")) < 1.5).alias("close"))


QUERIES = {f.__name__: f for f in (covered_panels, placed_panel_antijoin, planning_roof, obstacle_layouts, roof_neighbours, building_selection, roof_plane, ring_measures, utm_coordinates, layout_totals, face_layouts, energy_null_propagation, facet_validity, panel_clearance_antijoin, image_window, tile_grid, polygon_area_shoelace, pixel_world_affine, connected_parts, grown_parts, alignment_gates, building_ledger, crs_round_trip)}

_TILES = "list_sort(list_distinct(list_concat(range(0, greatest({0} - tile, 0) + 1, tile * 3 // 4), [greatest({0} - tile, 0)])))"
_FIT = f"""faces AS ({fixture_sql("faces")}),
panels AS (SELECT face_id, i, j, w, h, 0.5::DOUBLE + i * 2.0::DOUBLE AS x1, 0.5::DOUBLE + j * 2.0::DOUBLE AS y1 FROM faces, (SELECT unnest(range(20))::INTEGER AS i), (SELECT unnest(range(20))::INTEGER AS j)),
fit AS (SELECT *, x1 + 1.125 AS x2, y1 + 1.75 AS y2 FROM panels WHERE x1 + 1.125 <= w - 0.5 AND y1 + 1.75 <= h - 0.5)"""
_OBSTACLES = "SELECT DISTINCT l_partkey AS face_id, 2.0::DOUBLE + l_linenumber % 3 AS x1, 1.5::DOUBLE + (l_suppkey % 2) * 0.5::DOUBLE AS y1 FROM lineitem"
SQL = {
    "layout_totals": f"""WITH {_LAYOUT}
SELECT building_id, count(*) AS facets, sum(n)::BIGINT AS panel_count, round(sum(n) * 450 / 1000.0::DOUBLE, 2) AS kwp, round(sum(usable), 4) AS usable_area,
       round(CASE WHEN bool_or(kwh IS NULL) THEN NULL ELSE sum(kwh) END, 3) AS annual_kwh FROM done GROUP BY building_id""",
    "face_layouts": f"""WITH {_LAYOUT}
SELECT face_id, n::BIGINT AS panel_count, CASE WHEN n > 0 THEN i::BIGINT END AS layout, round(CASE WHEN w * h >= 1 THEN u * v ELSE 0 END, 4) AS surface_area FROM done""",
    "energy_null_propagation": """SELECT l_orderkey AS building_id, count(*) AS facets, sum(l_quantity::BIGINT)::BIGINT AS panel_count,
  round(CASE WHEN bool_or(l_partkey % 10 = 0) THEN NULL ELSE sum(l_quantity::BIGINT * 450 / 1000.0::DOUBLE * (900.0::DOUBLE + l_suppkey % 300) * 0.8::DOUBLE) END, 3) AS annual_kwh FROM lineitem GROUP BY l_orderkey""",
    "facet_validity": f"SELECT face_id, slope IS NOT NULL AND aspect IS NOT NULL AND coalesce(slope >= 0 AND slope < 80, FALSE) AS planned, (aspect + 180) % 360 AS azimuth FROM ({fixture_sql('faces')})",
    "panel_clearance_antijoin": f"""WITH {_FIT},
obstacles AS (SELECT l_partkey AS face_id, l_linenumber * 1.5::DOUBLE + (l_orderkey % 8) * 0.5::DOUBLE AS x1, (l_suppkey % 9)::DOUBLE AS y1 FROM lineitem)
SELECT face_id, i, j, x1, y1 FROM fit p WHERE NOT EXISTS (SELECT 1 FROM obstacles o WHERE o.face_id = p.face_id
  AND pow(greatest(p.x1 - (o.x1 + 0.5), o.x1 - p.x2, 0), 2) + pow(greatest(p.y1 - (o.y1 + 0.75), o.y1 - p.y2, 0), 2) < 0.25)""",
    "image_window": f"""SELECT id, CASE WHEN side <= 180 THEN side END AS side, CASE WHEN side <= 180 THEN least(1800, ceil(side / 0.1::DOUBLE))::BIGINT END AS pixels, printf('%.3f', extent / 8) AS bound
FROM (SELECT *, greatest(40.0::DOUBLE, extent + 12) AS side FROM ({fixture_sql("windows")}))""",
    "tile_grid": f"SELECT id, tile, unnest({_TILES.format('px_w')})::INTEGER AS x0, y0 FROM (SELECT id, tile, px_w, unnest({_TILES.format('px_h')})::INTEGER AS y0 FROM ({fixture_sql('windows')}), (SELECT unnest([512, 1000]) AS tile))",
    "covered_panels": f"WITH {_FIT} SELECT face_id, count(*) AS n, max(x2) AS right, max(y2) AS top FROM fit GROUP BY face_id",
    "placed_panel_antijoin": f"""WITH {_FIT}, placed AS (SELECT l_partkey AS face_id, (l_orderkey % 32) * 0.75::DOUBLE AS x1, (l_suppkey % 16)::DOUBLE AS y1 FROM lineitem WHERE l_linenumber = 1)
SELECT face_id, i, j FROM fit p WHERE NOT EXISTS (SELECT 1 FROM placed o WHERE o.face_id = p.face_id AND greatest(least(p.x2, o.x1 + 1.125) - greatest(p.x1, o.x1), 0) * greatest(least(p.y2, o.y1 + 1.75) - greatest(p.y1, o.y1), 0) > 1e-8)""",
    "planning_roof": f"""SELECT face_id, CASE WHEN face_id % 5 = 0 THEN w * h WHEN face_id % 3 = 0 THEN 0 ELSE (least(w, 9) - 1) * (least(h, 9) - 1) END AS area FROM ({fixture_sql("faces")})""",
    "obstacle_layouts": f"""WITH {_LAYOUT.split("best AS")[0].rstrip().rstrip(",")}, o AS ({_OBSTACLES}),
shut AS (SELECT f.face_id, CASE WHEN aspect % 180 = 0 THEN x1 ELSE y1 END - 0.5 AS a, CASE WHEN aspect % 180 = 0 THEN x1 ELSE y1 END + 1.0 AS c,
  (CASE WHEN aspect % 180 = 0 THEN y1 ELSE x1 END) / cos(radians(slope)) - 0.5 AS b, (CASE WHEN aspect % 180 = 0 THEN y1 ELSE x1 END + 0.5) / cos(radians(slope)) + 0.5 AS d FROM ok f JOIN o ON o.face_id = f.face_id),
spots AS (SELECT p.face_id, p.i, 0.6::DOUBLE + sx * ox + kx * sx AS x, 0.6::DOUBLE + sy * oy + ky * sy AS y, pw, ph, gap, iu FROM (SELECT *, unnest(range(0, greatest(nx, 0))) AS kx FROM places WHERE fits) p, (SELECT unnest(range(0, 400)) AS ky) WHERE ky < ny),
clear AS (SELECT face_id, i, count(*) AS n FROM spots s WHERE NOT (gap AND x < 0.6 + iu / 2 + 0.4::DOUBLE - 1e-8 AND x + pw > 0.6 + iu / 2 - 0.4::DOUBLE + 1e-8)
  AND NOT EXISTS (SELECT 1 FROM shut t WHERE t.face_id = s.face_id AND x < c - 1e-8 AND x + pw > a + 1e-8 AND y < d - 1e-8 AND y + ph > b + 1e-8) GROUP BY face_id, i),
inside AS (SELECT s.face_id, greatest(a, 0.6) AS x1, least(c, 0.6 + iu) AS x2, greatest(b, 0.6) AS y1, least(d, 0.6 + iv) AS y2 FROM shut s JOIN split f ON f.face_id = s.face_id
  UNION ALL SELECT face_id, 0.2::DOUBLE + iu / 2, 1.0::DOUBLE + iu / 2, 0.6, 0.6 + iv FROM split WHERE gap),
met AS (SELECT * FROM inside WHERE x2 > x1 AND y2 > y1), edges AS (SELECT DISTINCT face_id, unnest([x1, x2]) AS e FROM met), slabs AS (SELECT face_id, e, lead(e) OVER (PARTITION BY face_id ORDER BY e) AS f FROM edges),
cut AS (SELECT s.face_id, s.e, s.f, b.y1, b.y2, max(b.y2) OVER (PARTITION BY s.face_id, s.e ORDER BY b.y1, b.y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM slabs s JOIN met b ON s.face_id = b.face_id AND b.x1 <= s.e AND b.x2 >= s.f WHERE s.f IS NOT NULL),
lost AS (SELECT face_id, sum(greatest(0, y2 - greatest(y1, coalesce(seen, y1))) * (f - e)) AS u FROM cut GROUP BY face_id)
SELECT f.face_id, coalesce((SELECT max(n) FROM clear c WHERE c.face_id = f.face_id), 0)::BIGINT AS panels, round(CASE WHEN fits THEN iu * iv - coalesce(u, 0) ELSE 0 END, 4) AS usable_area, round(u_ * v_, 4) AS surface_area
FROM (SELECT *, u AS u_, v AS v_ FROM split) f LEFT JOIN (SELECT face_id AS k, u FROM lost) l ON l.k = f.face_id""".replace("coalesce(u, 0)", "coalesce(l.u, 0)"),
    "roof_neighbours": f"""WITH p AS (SELECT id, egid, x1 + id % 1000 * 16 AS x1, y1 + id % 777 * 16 AS y1, x2 + id % 1000 * 16 AS x2, y2 + id % 777 * 16 AS y2 FROM ({fixture_sql("parts")}))
SELECT a.id * 10 AS request, b.id FROM p a JOIN p b ON a.id = b.id OR (a.egid > 0 AND a.x1 - 20 < b.x2 AND b.x1 < a.x2 + 20 AND a.y1 - 20 < b.y2 AND b.y1 < a.y2 + 20) WHERE a.id % 50 = 0""",
    "building_selection": f"""WITH f AS (SELECT building_id AS request, face_id AS id FROM ({fixture_sql("faces")})), good AS (SELECT request FROM f WHERE request % 7 <> 0 GROUP BY request HAVING bool_and(id % 11 <> 0))
SELECT request, id FROM f WHERE request IN (FROM good) UNION ALL SELECT request, id FROM f WHERE id % 4 = 0 AND request NOT IN (FROM good)""",
    "roof_plane": f"""WITH f AS (SELECT *, CASE WHEN face_id % 6 = 0 THEN 0.5::DOUBLE ELSE slope END AS s FROM ({fixture_sql("faces")}) WHERE slope IS NOT NULL AND aspect IS NOT NULL AND slope < 80),
g AS (SELECT *, radians(CASE WHEN s < 1 THEN CASE WHEN w >= h THEN 0 ELSE 90 END ELSE (aspect + 180) % 360 END) AS a FROM f)
SELECT face_id, round(w * cos(a) - h * sin(a), 6) AS u, round((w * sin(a) + h * cos(a)) / cos(radians(s)), 6) AS v, TRUE AS same FROM g""",
    "ring_measures": f"""WITH r AS (SELECT face_id, w, h, (face_id % 4)::DOUBLE / 4 AS s FROM ({fixture_sql("faces")})), p AS (SELECT face_id, w, h, unnest([{{'x': 0.0, 'y': s}}, {{'x': w, 'y': 0.0}}, {{'x': w - s, 'y': h}}, {{'x': s, 'y': h + s}}]) AS p, unnest([{{'x': w, 'y': 0.0}}, {{'x': w - s, 'y': h}}, {{'x': s, 'y': h + s}}, {{'x': 0.0, 'y': s}}]) AS q FROM r),
m AS (SELECT *, p.x * q.y - q.x * p.y AS k, (w + 3 - p.x) * (q.x - p.x) + (h + 4 - p.y) * (q.y - p.y) AS dot, (q.x - p.x) ** 2 + (q.y - p.y) ** 2 AS len FROM p),
d AS (SELECT *, least(1, greatest(0, dot / len)) AS t FROM m)
SELECT face_id, round(sum((p.x + q.x) * k) / (3 * sum(k)), 9) AS x, round(sum((p.y + q.y) * k) / (3 * sum(k)), 9) AS y, round(min(sqrt((w + 3 - p.x - t * (q.x - p.x)) ** 2 + (h + 4 - p.y - t * (q.y - p.y)) ** 2)), 9) AS far FROM d GROUP BY face_id""",
    "utm_coordinates": f"""WITH c AS (SELECT id, radians(47.0::DOUBLE + y / 10000) AS f, radians((x - 5000) / 5000) AS l FROM ({fixture_sql("chips")})),
k AS (SELECT *, 6378137.0::DOUBLE AS a, 0.00669437999014132::DOUBLE AS e, 0.00669437999014132::DOUBLE / (1 - 0.00669437999014132::DOUBLE) AS e2 FROM c),
t AS (SELECT *, a / sqrt(1 - e * sin(f) ** 2) AS n, tan(f) ** 2 AS t, e2 * cos(f) ** 2 AS c, cos(f) * l AS b,
  a * ((1 - e / 4 - 3 * e ** 2 / 64 - 5 * e ** 3 / 256) * f - (3 * e / 8 + 3 * e ** 2 / 32 + 45 * e ** 3 / 1024) * sin(2 * f) + (15 * e ** 2 / 256 + 45 * e ** 3 / 1024) * sin(4 * f) - (35 * e ** 3 / 3072) * sin(6 * f)) AS m FROM k)
SELECT id, round(500000 + 0.9996::DOUBLE * n * (b + (1 - t + c) * b ** 3 / 6 + (5 - 18 * t + t ** 2 + 72 * c - 58 * e2) * b ** 5 / 120), 3) AS east,
  round(0.9996::DOUBLE * (m + n * tan(f) * (b ** 2 / 2 + (5 - t + 9 * c + 4 * c ** 2) * b ** 4 / 24 + (61 - 58 * t + t ** 2 + 600 * c - 330 * e2) * b ** 6 / 720)), 3) AS north FROM t""",
    "polygon_area_shoelace": f"""WITH r AS (SELECT face_id, w, h, (face_id % 4)::DOUBLE / 4 AS s FROM ({fixture_sql("faces")}))
SELECT face_id, abs((0 * 0 - w * s) + (w * h - (w - s) * 0) + ((w - s) * (h + s) - s * h) + (s * s - 0 * (h + s))) / 2 AS area, 0.0::DOUBLE AS min_x, h + s AS max_y FROM r""",
    "pixel_world_affine": f"""SELECT id, greatest(2640000.0::DOUBLE, least(2640128.0::DOUBLE, 2640000.0::DOUBLE + (px_w::DOUBLE + 200) * 128 / 1024)) AS x,
  greatest(1230000.0::DOUBLE, least(1230064.0::DOUBLE, 1230064.0::DOUBLE - (px_h::DOUBLE + 100) * 64 / 512)) AS y FROM ({fixture_sql("windows")})""",
    "connected_parts": f"""WITH RECURSIVE parts AS ({fixture_sql("parts")}),
edges AS (SELECT a.id AS a, b.id AS b FROM parts a JOIN parts b ON a.egid = b.egid AND a.egid > 0 AND a.id <> b.id
  AND pow(greatest(a.x1 - b.x2, b.x1 - a.x2, 0), 2) + pow(greatest(a.y1 - b.y2, b.y1 - a.y2, 0), 2) <= 2.25),
reach AS (SELECT id AS a, id AS b FROM parts UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT p.id, p.egid, min(r.b) AS house FROM parts p JOIN reach r ON p.id = r.a GROUP BY ALL""",
    "grown_parts": f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY egid ORDER BY id) AS i, count(*) OVER (PARTITION BY egid) AS n FROM ({fixture_sql("parts")}) WHERE egid > 0),
s AS (SELECT egid, n, 1::BIGINT AS i, false AS changed, [id] AS ids, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS held, x1, y1, x2, y2 FROM p WHERE i = 1
UNION ALL SELECT egid, n, i, CASE WHEN i = 1 THEN takes ELSE changed OR takes END, CASE WHEN takes THEN list_append(ids, id) ELSE ids END, CASE WHEN takes THEN list_append(held, b) ELSE held END,
  CASE WHEN takes THEN least(x1, b.x1) ELSE x1 END, CASE WHEN takes THEN least(y1, b.y1) ELSE y1 END, CASE WHEN takes THEN greatest(x2, b.x2) ELSE x2 END, CASE WHEN takes THEN greatest(y2, b.y2) ELSE y2 END
FROM (SELECT s.egid, s.n, p.i, s.changed, s.ids, s.held, s.x1, s.y1, s.x2, s.y2, p.id, {{'x1': p.x1, 'y1': p.y1, 'x2': p.x2, 'y2': p.y2}} AS b,
    NOT list_contains(s.ids, p.id) AND greatest(greatest(s.x2, p.x2) - least(s.x1, p.x1), greatest(s.y2, p.y2) - least(s.y1, p.y1)) <= 168
    AND list_min(list_transform(s.held, lambda h: pow(greatest(h.x1 - p.x2, p.x1 - h.x2, 0), 2) + pow(greatest(h.y1 - p.y2, p.y1 - h.y2, 0), 2))) <= 2.25 AS takes
  FROM s JOIN p ON s.egid = p.egid AND p.i = s.i % s.n + 1 WHERE s.n > 1 AND (s.i < s.n OR s.changed)))
SELECT egid, unnest(ids) AS id FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY egid ORDER BY len(ids) DESC) = 1)""",
    "alignment_gates": f"""SELECT id, CASE WHEN best < 30 OR best < base * 1.5 OR best - base < 12 THEN 'no_clear_improvement' WHEN rival IS NOT NULL AND best < rival * 1.12 THEN 'ambiguous_boundary'
  WHEN shift > 3.75 THEN 'search_limit' WHEN support < 3 THEN 'insufficient_directional_support' ELSE 'image_boundary_match' END AS reason FROM ({fixture_sql("scores")})""",
    "crs_round_trip": f"""WITH c AS (SELECT id, x / 1000000.0::DOUBLE AS y, y / 1000000.0::DOUBLE AS x FROM ({fixture_sql("chips")})),
d AS (SELECT id, x, y, (2.6779094::DOUBLE + 4.728982::DOUBLE * y + 0.791484::DOUBLE * y * x + 0.1306::DOUBLE * y * x * x - 0.0436::DOUBLE * y * y * y) * 100 / 36 AS lon,
  (16.9023892::DOUBLE + 3.238272::DOUBLE * x - 0.270978::DOUBLE * y * y - 0.002528::DOUBLE * x * x - 0.0447::DOUBLE * y * y * x - 0.0140::DOUBLE * x * x * x) * 100 / 36 AS lat FROM c),
e AS (SELECT *, (lat * 3600 - 169028.66::DOUBLE) / 10000 AS f, (lon * 3600 - 26782.5::DOUBLE) / 10000 AS g FROM d),
b AS (SELECT *, 72.37::DOUBLE + 211455.93::DOUBLE * g - 10938.51::DOUBLE * g * f - 0.36::DOUBLE * g * f * f - 44.54::DOUBLE * g * g * g - y * 1000000 AS de,
  147.07::DOUBLE + 308807.95::DOUBLE * f + 3745.25::DOUBLE * g * g + 76.63::DOUBLE * f * f - 194.56::DOUBLE * g * g * f + 119.79::DOUBLE * f * f * f - x * 1000000 AS dn FROM e)
SELECT id, round(lon, 7) AS lon, round(lat, 7) AS lat, sqrt(de * de + dn * dn) < 1.5 AS close FROM b""",
}
