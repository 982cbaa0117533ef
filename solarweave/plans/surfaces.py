"""Queries on faces' areas, masks, obstacles, windows, edges and registration."""

from __future__ import annotations

from pyspark.sql import functions as F

from solarweave.operators import evaluation, fusion, packing, raster, surfaces
from solarweave.operators import registration as registration_
from solarweave.plans.fixtures import RASTER_SQL, fixture, fixture_sql
from solarweave.plans.rasters import _FIT, _RISE, _grid
from solarweave.storage import stored, table


def _placed(spark, sf_dir):
    """Faces as boxes side by side in their building, some overlapping."""
    f = fixture(spark, sf_dir, "faces")
    x, y = (F.col("face_id") % 7) * 3.0, (F.col("face_id") % 5) * 2.0
    return f.select("building_id", "face_id", x.alias("x1"), y.alias("y1"), (x + F.col("w")).alias("x2"), (y + F.col("h")).alias("y2"))


def visible_faces(spark, sf_dir):
    """What earlier faces of a building leave of each face."""
    return surfaces.visible_area(_placed(spark, sf_dir), "building_id", "face_id", 16.0)


def free_roof(spark, sf_dir):
    """What blocking detections leave of the 4 x 4 m roof of their analysis."""
    d = fixture(spark, sf_dir, "order_boxes").filter(fusion.blocks_placement(F.col("kind")))
    roofs = d.select("analysis").distinct().select("analysis", F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(4.0).alias("x2"), F.lit(4.0).alias("y2"))
    return surfaces.uncovered_area(roofs, d.select("analysis", "x1", "y1", "x2", "y2"), "analysis", 4.0)


def pv_obstacle_overlap(spark, sf_dir):
    """Areas that panels, obstacles and shadows cover by analysis, and what obstacles take of the panels'."""
    d = fixture(spark, sf_dir, "order_boxes").withColumn("kind", F.when(F.col("seq") % 4 == 3, "shadow").otherwise(F.col("kind")))
    return evaluation.site_areas(d.select(F.col("analysis").alias("site"), "kind", fusion.blocks_placement(F.col("kind")).alias("blocks"), "x1", "y1", "x2", "y2"), 4.0)


def ring_even_odd(spark, sf_dir):
    """Area of an outer ring with a hole and an island, given in any order and direction, and of a second part beside it."""
    f = fixture(spark, sf_dir, "faces")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    box = lambda a, b, c, d: F.array(pt(a, b), pt(c, b), pt(c, d), pt(a, d))
    n = lambda v: F.lit(float(v))
    hole, island, outer = F.reverse(box(n(1), n(1), n(2), n(2))), box(n(1.25), n(1.25), n(1.75), n(1.75)), box(n(0), n(0), F.col("w"), F.col("h"))
    beside = box(F.col("w") + 1, n(0), F.col("w") + 1 + F.col("face_id") % 4 / 4, n(2))
    rings = F.when(F.col("face_id") % 2 == 0, F.array(hole, outer, beside, island)).otherwise(F.array(island, beside, F.reverse(outer), hole))
    return f.select("face_id", surfaces.even_odd_area(rings).alias("area"))


def ordinal_attributes(spark, sf_dir):
    """Attributes joined to faces by their place in the building, as two lists in one order."""
    f = fixture(spark, sf_dir, "faces").groupBy("building_id").agg(F.array_sort(F.collect_list("face_id")).alias("ids"), F.array_sort(F.collect_list(F.struct("face_id", "w"))).alias("items"))
    geometry = f.select("building_id", F.posexplode("ids").alias("place", "face_id"))
    attributes = f.select("building_id", F.posexplode(F.transform("items", lambda x: x["w"])).alias("place", "w"))
    return geometry.join(attributes, ["building_id", "place"])


def pixel_confusion(spark, sf_dir):
    """Predicted against true cells of each image, and scores of all."""
    g = _grid(spark, sf_dir)
    truth = g.select("image", "r", "c", (F.col("z") > 0.05).alias("t"))
    predicted = g.select("image", F.col("r"), ((F.col("c") + 1) % 8).cast("int").alias("c"), (F.col("z") > 0.0).alias("p"))
    return evaluation.with_scores(evaluation.confusion(truth.join(predicted, ["image", "r", "c"]), F.col("t"), F.col("p"), "image"))


def conversion_iou(spark, sf_dir):
    """Least and mean agreement of masks with their boxes; 1 where both are empty."""
    m = _grid(spark, sf_dir).filter("z > 0.2").groupBy("image").agg(F.count("*").alias("cells"), ((F.max("r") - F.min("r") + 1) * (F.max("c") - F.min("c") + 1)).alias("box"))
    every = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"))
    iou = every.join(m, "image", "left").select("image", F.coalesce(F.col("cells") / F.col("box"), F.lit(1.0)).alias("iou"))
    return iou.agg(F.min("iou").alias("least"), F.round(F.avg("iou"), 9).alias("mean"), F.count("*").alias("n"))


def _faced(spark, sf_dir):
    """Heights of each grid with its left and right halves as two faces."""
    return _grid(spark, sf_dir).withColumn("z", F.col("z") * 16).withColumn("face", F.when(F.col("c") >= 4, 1).otherwise(0))


def _judged_heights(spark, sf_dir):
    g = raster.face_cores(_faced(spark, sf_dir))
    by_face = g.withColumn("image", F.col("image") * 2 + F.col("face"))
    split = lambda df, *c: df.select(F.floor(F.col("image") / 2).alias("image"), (F.col("image") % 2).cast("int").alias("face"), *c)
    planes = raster.plane_fits(by_face)
    left = by_face.join(planes.select("image", "a", "b", "z0"), "image").withColumn("left", F.col("z") - F.col("a") * F.col("c") - F.col("b") * F.col("r") - F.col("z0"))
    return surfaces.raised_and_dropped(g, split(planes, "a", "b", "z0"), split(raster.rise_thresholds(left, F.col("left")), "threshold"))


def height_obstacles(spark, sf_dir):
    """Raised and dropped parts of each grid, judged in the cores of its two faces: area, height and kind."""
    j = stored(_judged_heights(spark, sf_dir), "judged")
    marked = [raster.closed(j, F.col(m)).filter("v = 1").select((F.col("image") * 2 + k).alias("image"), "r", "c", F.when(F.col(m) == 1, F.abs("residual")).alias("depth")) for k, m in enumerate(("raised", "dropped"))]
    whole = stored(marked[0].union(marked[1]), "marked")
    cells = stored(raster.components(whole).join(whole, ["image", "r", "c"]).withColumn("roof_area", F.lit(16.0)), "parts")
    both = surfaces.obstacles(cells.filter("image % 2 = 0")).unionByName(surfaces.obstacles(cells.filter("image % 2 = 1"), below=True))
    return both.select(F.floor(F.col("image") / 2).alias("image"), (F.col("image") % 2 == 1).alias("below"), (F.col("component.r") * 8 + F.col("component.c")).alias("first_cell"), "cells", "area", F.round("height", 6).alias("height"), "kind", "place")


def roof_windows(spark, sf_dir):
    """Components of blue contrast against their surroundings that have a window's size and shape."""
    g = _grid(spark, sf_dir).withColumn("blue", F.floor(F.col("z") * 256)).withColumn("red", (F.col("r") * 7 + F.col("c") * 3) % 16).withColumn("roof", F.lit(True))
    hits = surfaces.contrast_hits(g, 2.0).filter("hit = 1")
    out = surfaces.windows(raster.components(hits.select("image", "r", "c")), 2.0)
    return out.select("image", (F.col("component.r") * 8 + F.col("component.c")).alias("first_cell"), "cells", "area", F.round("fill", 6).alias("fill"), F.round("grown_area", 6).alias("grown_area"), "place")


def registration(spark, sf_dir):
    """Outlines laid on images of 80 x 80 pixels: each value of a vector is a square of ten, and a bright roof lies up to five pixels off.

    A vector in six has no roof, and in one of seven its roof is smaller than the outline.
    """
    e = table(spark, sf_dir, "embeddings").filter("size(embedding) >= 64").select(F.col("vec_id").alias("image"), F.slice("embedding", 1, 64).alias("z"))
    shades = lambda red, green, blue: F.transform("z", lambda v: registration_.grey(*(k + F.floor(F.abs(v) * 24) for k in (red, green, blue))).cast("int"))
    less = F.when(F.col("image") % 7 == 0, 3).otherwise(0)
    first = lambda n, back: (F.col("image") % n - back + 10 + less).cast("int")
    roof = packing.dealt(e, "image").select("image", shades(80, 55, 40).alias("bright"), shades(30, 30, 30).alias("dark"), first(11, 5).alias("left"), first(5, 2).alias("top"), F.when(F.col("image") % 6 != 5, 59 - 2 * less).otherwise(-1).alias("side"))
    # a line of pixels for each line of squares, all roof and all ground; a line of the image is one of these, or ground with a piece of roof
    lines = lambda shade: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.flatten(F.transform(F.slice(shade, k * 8 + 1, 8), lambda v: F.array_repeat(v, 10))))
    begin, end = F.greatest("left", F.lit(0)), F.least(F.col("left") + F.col("side") + 1, F.lit(80))
    drawn = roof.select("image", lines("bright").alias("bright"), lines("dark").alias("dark"), begin.alias("begin"), F.greatest(end, begin).alias("end"), "top", "side")

    def row(r):
        on = (r >= F.col("top")) & (r <= F.col("top") + F.col("side"))
        bright, dark = (F.get(c, F.floor(r / 10).cast("int")) for c in ("bright", "dark"))
        return F.when(on, F.concat(F.slice(dark, 1, F.col("begin")), F.slice(bright, F.col("begin") + 1, F.col("end") - F.col("begin")), F.slice(dark, F.col("end") + 1, 80))).otherwise(dark)

    outline = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((10, 10), (70, 10), (70, 70), (10, 70))))
    images = drawn.select("image", F.lit(80).alias("width"), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(79)), row)).alias("values"), F.array(outline).alias("rings"), F.lit(40.0).alias("x"), F.lit(40.0).alias("y"))
    out = registration_.registered_images(images, 0.5)
    return out.select("image", "points", "dx", "dy", F.round("scale", 2).alias("scale"), F.round("base", 4).alias("base"), F.round("best", 4).alias("best"), F.round("rival", 4).alias("rival"), "support", "reason", "applied")


def mask_polygons(spark, sf_dir):
    """Label lines of each grid's parts above 0.1, and how well the lines' polygons fit the mask."""
    parts = raster.components(_grid(spark, sf_dir).filter("z > 0.1"))
    return surfaces.mask_polygons(parts.select("image", (F.col("component.r") * 8 + F.col("component.c")).alias("part"), "r", "c"), 8, 8).select("image", F.size("lines").alias("n"), F.concat_ws(";", "lines").alias("lines"), "agreement")


def edge_gradients(spark, sf_dir):
    """Sobel gradients of the smoothed grid, where they lie inside."""
    g = _grid(spark, sf_dir).withColumn("k", F.floor(F.col("z") * 256).cast("double"))
    return surfaces.edges(g, "k").filter("gx is not null and gy is not null").select("image", "r", "c", F.round("gx", 6).alias("gx"), F.round("gy", 6).alias("gy"))


def registration_shift(spark, sf_dir):
    """The shift that lays a fixed outline best on the edges of each grid."""
    g = _grid(spark, sf_dir).withColumn("k", F.floor(F.col("z") * 256).cast("double"))
    outline = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.inline(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(nx).alias("nx"), F.lit(1.0 - nx).alias("ny")) for r, c, nx in ((3, 3, 1.0), (3, 4, 0.0), (4, 3, 0.0), (4, 4, 1.0))))))
    best = surfaces.best_shift(surfaces.shift_scores(outline, surfaces.edges(g, "k"), 1))
    return best.select("image", F.round("score", 6).alias("score"), "dx", "dy")


def simplified_outline(spark, sf_dir):
    """Points of the profile of each row of each grid that a simplification keeps."""
    g = _grid(spark, sf_dir)
    return surfaces.simplified(g.select((F.col("image") * 8 + F.col("r")).alias("id"), F.col("c").cast("long").alias("n"), F.col("c").cast("double").alias("x"), (F.col("z") * 8).alias("y")), "window")


def every_seventh(spark, sf_dir):
    """Every seventh chip of each block of 500, by id."""
    return surfaces.every_nth(fixture(spark, sf_dir, "chips"), "block", "id", 7).select("block", "id")


def checkpoint_compatible(spark, sf_dir):
    """Checkpoints that can serve obstacles."""
    p = table(spark, sf_dir, "part")
    names = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("pv_installation"))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("chimney"), F.lit("skylight"))).otherwise(F.array(F.lit("chimney"), F.lit("car")))
    return p.select("p_partkey", surfaces.compatible(names, fusion.KINDS, F.when(F.col("p_partkey") % 2 == 0, "segment").otherwise("detect")).alias("fits"))


def roof_at_point(spark, sf_dir):
    """Faces that hold the point (10, 5), and those whose box meets the envelope 70 m around (80, 80)."""
    p = _placed(spark, sf_dir)
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(pt("x1", "y1"), pt("x2", "y1"), pt("x2", "y2"), pt("x1", "y2"))
    held = (F.lit(10.0).between(F.col("x1"), F.col("x2")) & F.lit(5.0).between(F.col("y1"), F.col("y2"))) & raster.inside(ring, F.lit(10.0), F.lit(5.0))
    return p.select("face_id", held.alias("holds"), ((F.col("x2") >= 10) & (F.col("y2") >= 10) & (F.col("x1") <= 150) & (F.col("y1") <= 150)).alias("near"))


def split_list(spark, sf_dir):
    """A list of names, as many different ones as it must hold."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return surfaces.whole_list(n, "name", 25)


QUERIES = {f.__name__: f for f in (registration, mask_polygons, visible_faces, free_roof, pv_obstacle_overlap, ring_even_odd, ordinal_attributes, pixel_confusion, conversion_iou, height_obstacles, roof_windows, edge_gradients, registration_shift, simplified_outline, every_seventh, checkpoint_compatible, roof_at_point, split_list)}

_PLACED = f"SELECT building_id, face_id, (face_id % 7) * 3.0::DOUBLE AS x1, (face_id % 5) * 2.0::DOUBLE AS y1, (face_id % 7) * 3.0::DOUBLE + w AS x2, (face_id % 5) * 2.0::DOUBLE + h AS y2 FROM ({fixture_sql('faces')})"


def _union(source: str, key: str, name: str) -> str:
    return f"""{name}_edges AS (SELECT DISTINCT {key}, unnest([x1, x2]) AS e FROM {source} WHERE x2 > x1 AND y2 > y1),
{name}_slabs AS (SELECT {key}, e, lead(e) OVER (PARTITION BY {key} ORDER BY e) AS f FROM {name}_edges),
{name}_in AS (SELECT s.{key}, s.e, s.f, b.y1, b.y2, max(b.y2) OVER (PARTITION BY s.{key}, s.e ORDER BY b.y1, b.y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM {name}_slabs s JOIN {source} b ON s.{key} = b.{key} AND b.x1 <= s.e AND b.x2 >= s.f AND b.y2 > b.y1 WHERE s.f IS NOT NULL),
{name} AS (SELECT {key}, sum(greatest(0, y2 - greatest(y1, coalesce(seen, y1))) * (f - e)) AS u FROM {name}_in GROUP BY {key})"""


_SMOOTH = f"""g AS (SELECT image, r, c, floor(z * 256) AS k FROM ({RASTER_SQL})),
wt(d, w) AS (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)),
s1 AS (SELECT a.image, a.r, a.c, sum(b.k * w) / 16 AS s FROM g a, wt JOIN g b ON a.image = b.image AND a.r = b.r AND b.c = a.c + d GROUP BY ALL HAVING count(*) = 5),
s2 AS (SELECT a.image, a.r, a.c, sum(b.s * w) / 16 AS s FROM s1 a, wt JOIN s1 b ON a.image = b.image AND a.c = b.c AND b.r = a.r + d GROUP BY ALL HAVING count(*) = 5),
sob(dr, dc, wx, wy) AS (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 0, 0, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)),
grad AS (SELECT a.image, a.r, a.c, sum(b.s * wx) AS gx, sum(b.s * wy) AS gy FROM s2 a, sob JOIN s2 b ON a.image = b.image AND b.r = a.r + dr AND b.c = a.c + dc GROUP BY ALL HAVING count(*) = 9)"""
_REACH = "reach AS (SELECT image, r, c, r * 8 + c AS k FROM cell UNION SELECT a.image, b.r, b.c, a.k FROM reach a JOIN cell b ON a.image = b.image AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1), comp AS (SELECT image, r, c, min(k) AS first_cell FROM reach GROUP BY image, r, c)"
SQL = {
    "visible_faces": f"""WITH p AS ({_PLACED}), k AS (SELECT a.face_id, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1, least(a.x2, b.x2) AS x2, least(a.y2, b.y2) AS y2 FROM p a JOIN p b ON a.building_id = b.building_id AND b.face_id < a.face_id),
{_union("k", "face_id", "un")} SELECT p.face_id, (x2 - x1) * (y2 - y1) AS area, (x2 - x1) * (y2 - y1) - coalesce(u, 0) AS free_area FROM p LEFT JOIN un ON p.face_id = un.face_id""",
    "free_roof": f"""WITH k AS (SELECT analysis, x1, y1, least(x2, 4) AS x2, least(y2, 4) AS y2 FROM ({fixture_sql("order_boxes")}) WHERE kind <> 'shadow'),
{_union("k", "analysis", "un")} SELECT DISTINCT k.analysis, 16.0::DOUBLE AS area, 16 - coalesce(u, 0) AS free_area FROM k LEFT JOIN un ON k.analysis = un.analysis""",
    "pv_obstacle_overlap": f"""WITH d AS (SELECT * REPLACE (CASE WHEN seq % 4 = 3 THEN 'shadow' ELSE kind END AS kind) FROM ({fixture_sql("order_boxes")})), pvb AS (SELECT * FROM d WHERE kind = 'pv_installation'), hb AS (SELECT * FROM d WHERE kind = 'chimney'), sb AS (SELECT * FROM d WHERE kind = 'shadow'),
met AS (SELECT a.analysis, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1, least(a.x2, b.x2) AS x2, least(a.y2, b.y2) AS y2 FROM pvb a JOIN hb b ON a.analysis = b.analysis),
{_union("pvb", "analysis", "pu")}, {_union("hb", "analysis", "hu")}, {_union("sb", "analysis", "su")}, {_union("met", "analysis", "mu")}
SELECT i.analysis AS site, coalesce(pu.u, 0) AS pv, coalesce(hu.u, 0) AS hard, coalesce(su.u, 0) AS advisory, coalesce(mu.u, 0) AS overlap, CASE WHEN coalesce(pu.u, 0) > 0 THEN round(coalesce(mu.u, 0) / pu.u, 4) ELSE 0 END AS share
FROM (SELECT DISTINCT analysis FROM d) i LEFT JOIN pu ON i.analysis = pu.analysis LEFT JOIN hu ON i.analysis = hu.analysis LEFT JOIN su ON i.analysis = su.analysis LEFT JOIN mu ON i.analysis = mu.analysis""",
    "ring_even_odd": f"SELECT face_id, w * h - 1.0::DOUBLE + 0.25::DOUBLE + face_id % 4 / 2 AS area FROM ({fixture_sql('faces')})",
    "ordinal_attributes": f"SELECT building_id, (row_number() OVER (PARTITION BY building_id ORDER BY face_id) - 1)::INTEGER AS place, face_id, w FROM ({fixture_sql('faces')})",
    "pixel_confusion": f"""WITH g AS ({RASTER_SQL}), j AS (SELECT a.image, a.z > 0.05::DOUBLE AS t, b.z > 0 AS p FROM g a JOIN g b ON a.image = b.image AND a.r = b.r AND a.c = (b.c + 1) % 8),
n AS (SELECT image, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM j GROUP BY image)
SELECT *, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn)::DOUBLE END AS iou, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS dice, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END AS recall FROM n""",
    "conversion_iou": f"""WITH m AS (SELECT image, count(*) AS n, (max(r) - min(r) + 1) * (max(c) - min(c) + 1) AS b FROM ({RASTER_SQL}) WHERE z > 0.2 GROUP BY image)
SELECT min(coalesce(n / b::DOUBLE, 1)) AS least, round(avg(coalesce(n / b::DOUBLE, 1)), 9) AS mean, count(*) AS n FROM embeddings e LEFT JOIN m ON e.vec_id = m.image""",
    "height_obstacles": f"""WITH RECURSIVE whole AS (SELECT image AS own, image * 2 + (c >= 4)::INTEGER AS image, r, c, z * 16 AS z FROM ({RASTER_SQL})), g AS (SELECT image, r, c, z FROM whole), {_FIT},
res AS (SELECT w.own, w.image, w.r, w.c, w.z - f.a * w.c - f.b * w.r - (f.z - f.a * f.x - f.b * f.y) / f.n AS v FROM whole w JOIN fit f ON w.image = f.image), vals AS (SELECT image, v FROM res), {_RISE},
mark AS (SELECT own AS image, r, c, v, b, (c NOT IN (3, 4) AND CASE WHEN b THEN v < -1.5 ELSE v > threshold END)::INTEGER AS m FROM res JOIN rise USING (image), (SELECT unnest([FALSE, TRUE]) AS b)),
dil AS (SELECT x.image, x.b, x.r, x.c, max(y.m) AS m FROM mark x JOIN mark y ON x.image = y.image AND x.b = y.b AND abs(x.r - y.r) <= 1 AND abs(x.c - y.c) <= 1 GROUP BY ALL),
cls AS (SELECT x.image, x.b, x.r, x.c, min(y.m) AS m FROM dil x JOIN dil y ON x.image = y.image AND x.b = y.b AND abs(x.r - y.r) <= 1 AND abs(x.c - y.c) <= 1 GROUP BY ALL),
cell AS (SELECT image * 2 + b::INTEGER AS image, r, c FROM cls WHERE m = 1), {_REACH},
part AS (SELECT p.image, first_cell, count(*) AS cells, max(p.r) - min(p.r) + 1 AS h, max(p.c) - min(p.c) + 1 AS w, max(abs(k.v)) FILTER (k.m = 1) AS height
  FROM comp p JOIN mark k ON k.image = p.image // 2 AND k.b = (p.image % 2 = 1) AND k.r = p.r AND k.c = p.c GROUP BY p.image, first_cell),
kept AS (SELECT image // 2 AS image, image % 2 = 1 AS below, first_cell, cells, cells * 0.25::DOUBLE AS area, round(height, 6) AS height FROM part
  WHERE least(h, w) >= 2 AND CASE WHEN image % 2 = 1 THEN cells >= 16 AND cells * 0.25 <= 16 * 0.95 ELSE cells * 0.25 >= 0.35 AND cells * 0.25 <= 8 END)
SELECT *, CASE WHEN NOT below AND area <= 2.5 THEN 'chimney' ELSE 'other_obstacle' END AS kind, row_number() OVER (PARTITION BY image, below ORDER BY area DESC, first_cell)::INTEGER AS place FROM kept QUALIFY place <= 40""",
    "roof_windows": f"""WITH RECURSIVE g AS (SELECT image, r, c, floor(z * 256) - (r * 7 + c * 3) % 16 AS k FROM ({RASTER_SQL})), d AS (SELECT unnest(range(-3, 4)) AS d),
spot AS (SELECT p, q, CASE WHEN p + d < 0 THEN -(p + d) WHEN p + d > 7 THEN 14 - p - d ELSE p + d END AS pr, CASE WHEN q + e < 0 THEN -(q + e) WHEN q + e > 7 THEN 14 - q - e ELSE q + e END AS pc
  FROM (SELECT unnest(range(8)) AS p), (SELECT unnest(range(8)) AS q), d, (SELECT d AS e FROM d)),
k AS (SELECT a.image, a.r, a.c, any_value(a.k) - sum(b.k) / 49 AS v FROM g a JOIN spot ON a.r = p AND a.c = q JOIN g b ON b.image = a.image AND b.r = pr AND b.c = pc GROUP BY a.image, a.r, a.c),
mid AS (SELECT image, quantile_cont(v, 0.5) AS m FROM k GROUP BY image), lim AS (SELECT k.image, any_value(m) + greatest(8, 3 * 1.4826::DOUBLE * quantile_cont(abs(v - m), 0.5)) AS t FROM k JOIN mid USING (image) GROUP BY k.image),
hit AS (SELECT k.image, r, c, (v > t)::INTEGER AS m FROM k JOIN lim USING (image)),
dil AS (SELECT x.image, x.r, x.c, max(y.m) AS m FROM hit x JOIN hit y ON x.image = y.image AND abs(x.r - y.r) <= 1 AND abs(x.c - y.c) <= 1 GROUP BY ALL),
cell AS (SELECT x.image, x.r, x.c FROM dil x JOIN dil y ON x.image = y.image AND abs(x.r - y.r) <= 1 AND abs(x.c - y.c) <= 1 GROUP BY ALL HAVING min(y.m) = 1), {_REACH},
parts AS (SELECT image, first_cell, count(*) AS cells, max(r) - min(r) + 1 AS h, max(c) - min(c) + 1 AS w FROM comp GROUP BY image, first_cell)
SELECT image, first_cell, cells, cells * 0.25::DOUBLE AS area, round(cells / (h * w)::DOUBLE, 6) AS fill, round((h + 0.8::DOUBLE) * (w + 0.8::DOUBLE) * 0.25, 6) AS grown_area,
  row_number() OVER (PARTITION BY image ORDER BY (h + 0.8::DOUBLE) * (w + 0.8::DOUBLE) * 0.25 DESC, first_cell)::INTEGER AS place
FROM parts WHERE cells * 0.25 BETWEEN 0.25 AND 6 AND w / h::DOUBLE BETWEEN 0.3::DOUBLE AND 3.4::DOUBLE AND cells / (h * w)::DOUBLE >= 0.55::DOUBLE QUALIFY place <= 60""",
    "edge_gradients": f"WITH {_SMOOTH} SELECT image, r, c, round(gx, 6) AS gx, round(gy, 6) AS gy FROM grad",
    "registration": """WITH e AS (SELECT vec_id AS image, embedding AS z FROM embeddings WHERE len(embedding) >= 64), side AS (SELECT unnest(range(80)) AS i),
colour AS (SELECT image, y.i AS r, x.i AS c, floor(abs(z[(y.i // 10) * 8 + x.i // 10 + 1]) * 24) AS v,
  image % 6 <> 5 AND x.i - image % 11 + 5 BETWEEN 10 + l AND 69 - l AND y.i - image % 5 + 2 BETWEEN 10 + l AND 69 - l AS roof FROM (SELECT *, CASE WHEN image % 7 = 0 THEN 3 ELSE 0 END AS l FROM e), side y, side x),
g AS (SELECT image, r, c, floor((CASE WHEN roof THEN 80 ELSE 30 END + v) * 0.299::DOUBLE + (CASE WHEN roof THEN 55 ELSE 30 END + v) * 0.587::DOUBLE + (CASE WHEN roof THEN 40 ELSE 30 END + v) * 0.114::DOUBLE + 0.5::DOUBLE) AS k FROM colour),
s1 AS (SELECT image, r, c, CASE WHEN count(*) OVER w = 5 THEN (lag(k, 2) OVER o + lag(k) OVER o * 4 + k * 6 + lead(k) OVER o * 4 + lead(k, 2) OVER o) / 16 END AS s FROM g WINDOW o AS (PARTITION BY image, r ORDER BY c), w AS (PARTITION BY image, r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
s2 AS (SELECT image, r, c, floor((lag(s, 2) OVER o + lag(s) OVER o * 4 + s * 6 + lead(s) OVER o * 4 + lead(s, 2) OVER o) / 16 + 0.5::DOUBLE) AS s FROM s1 WINDOW o AS (PARTITION BY image, c ORDER BY r)),
d AS (SELECT image, r, c, lead(s) OVER o - lag(s) OVER o AS a, lag(s) OVER o + 2 * s + lead(s) OVER o AS b FROM s2 WINDOW o AS (PARTITION BY image, r ORDER BY c)),
grad AS (SELECT image, r, c, lag(a) OVER o + 2 * a + lead(a) OVER o AS gx, lead(b) OVER o - lag(b) OVER o AS gy FROM d WINDOW o AS (PARTITION BY image, c ORDER BY r)),
k AS (SELECT unnest(range(17)) * 3 + 5 AS t),
pt(x, y, way) AS (SELECT 10 + t, 10, 3 FROM k UNION ALL SELECT 70, 10 + t, 0 FROM k UNION ALL SELECT 70 - t, 70, 2 FROM k UNION ALL SELECT 10, 70 - t, 1 FROM k),
sh AS (SELECT a.d AS dx, b.d AS dy, step FROM (SELECT unnest(range(-8, 9)) AS d) a, (SELECT unnest(range(-8, 9)) AS d) b, (SELECT unnest(range(11)) AS step) WHERE a.d * a.d + b.d * b.d <= 64),
seen AS (SELECT step, dx, dy, way, round_even(40 + (x - 40) * (0.9::DOUBLE + step / 100::DOUBLE) + dx, 0)::BIGINT AS c, round_even(40 + (y - 40) * (0.9::DOUBLE + step / 100::DOUBLE) + dy, 0)::BIGINT AS r FROM pt, sh),
sc AS (SELECT image, step, dx, dy, sum(f) / 68 AS score, sum(f) FILTER (way = 0) / 17 AS w0, sum(f) FILTER (way = 1) / 17 AS w1, sum(f) FILTER (way = 2) / 17 AS w2, sum(f) FILTER (way = 3) / 17 AS w3
  FROM (SELECT image, step, dx, dy, way, least(abs(coalesce(CASE WHEN way < 2 THEN gx ELSE gy END, 0)), 100) AS f FROM seen JOIN grad USING (r, c)) GROUP BY ALL),
top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC, dx DESC, dy DESC, step DESC) = 1),
still AS (SELECT * FROM sc WHERE step = 10 AND dx = 0 AND dy = 0),
second AS (SELECT sc.image, max(sc.score) AS rival FROM sc JOIN top ON sc.image = top.image AND (sqrt((sc.dx - top.dx) ** 2 + (sc.dy - top.dy) ** 2) * 0.5::DOUBLE > 0.75::DOUBLE OR abs(sc.step - top.step) >= 3) GROUP BY sc.image),
q AS (SELECT t.image, 68::BIGINT AS points, t.dx, t.dy, round(0.9::DOUBLE + t.step / 100::DOUBLE, 2) AS scale, b.score AS base, t.score AS best, rival, (t.w0 - b.w0 > 8)::BIGINT + (t.w1 - b.w1 > 8)::BIGINT + (t.w2 - b.w2 > 8)::BIGINT + (t.w3 - b.w3 > 8)::BIGINT AS support
  FROM top t JOIN still b USING (image) JOIN second USING (image)),
why AS (SELECT *, CASE WHEN best < 30 OR best < base * 1.5::DOUBLE OR best - base < 12 THEN 'no_clear_improvement' WHEN best < rival * 1.12::DOUBLE THEN 'ambiguous_boundary' WHEN sqrt(dx * dx + dy * dy) * 0.5::DOUBLE > 3.75::DOUBLE THEN 'search_limit'
  WHEN support < 3 THEN 'insufficient_directional_support' ELSE 'image_boundary_match' END AS reason FROM q)
SELECT image, points, dx, dy, scale, round(base, 4) AS base, round(best, 4) AS best, round(rival, 4) AS rival, support, reason, reason = 'image_boundary_match' AS applied FROM why""",
    "registration_shift": f"""WITH {_SMOOTH}, pts(r, c, nx, ny) AS (VALUES (3, 3, 1, 0), (3, 4, 0, 1), (4, 3, 0, 1), (4, 4, 1, 0)), sh(dx, dy) AS (VALUES (-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)),
sc AS (SELECT image, dx, dy, avg(least(abs(gx * nx + gy * ny), 100)) AS score FROM pts, sh JOIN grad ON grad.r = pts.r + dy AND grad.c = pts.c + dx GROUP BY ALL)
SELECT image, round(score, 6) AS score, dx, dy FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, dx DESC, dy DESC) AS n FROM sc) WHERE n = 1""",
    "every_seventh": f"SELECT block, id FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY id) AS n FROM ({fixture_sql('chips')})) WHERE (n - 1) % 7 = 0",
    "checkpoint_compatible": "SELECT p_partkey, p_partkey % 3 = 1 AND p_partkey % 2 = 0 AS fits FROM part",
    "roof_at_point": f"""SELECT face_id, x1 <= 10 AND x2 >= 10 AND y1 <= 5 AND y2 >= 5 AND y1 <> y2 AND ((y1 > 5) <> (y2 > 5)) AND x1 <= 10 AND x2 > 10 AS holds, x2 >= 10 AND y2 >= 10 AND x1 <= 150 AND y1 <= 150 AS near FROM ({_PLACED})""",
    "split_list": "SELECT count(*) AS listed, count(DISTINCT n_name) AS different FROM nation",
}
