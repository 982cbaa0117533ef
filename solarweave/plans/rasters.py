"""Queries on rasters: embeddings of 64 values are read as 8 x 8 grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from solarweave.operators import raster
from solarweave.plans.fixtures import RASTER_SQL
from solarweave.storage import table


def _grid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").filter("size(embedding) >= 64").select("vec_id", F.slice("embedding", 1, 64).alias("z"))
    return raster.cells(e, "vec_id", "z", 8)


def raster_morphology(spark, sf_dir):
    """Mask of positive cells, eroded, and closed, by 3 x 3."""
    g = _grid(spark, sf_dir).withColumn("m", (F.col("z") > 0).cast("int"))
    both = raster.eroded(g, F.col("m")).withColumnRenamed("v", "eroded")
    return raster.closed(both, F.col("m")).select("image", "r", "c", "m", "eroded", F.col("v").alias("closed"))


def raster_blur(spark, sf_dir):
    """Mean of each whole 3 x 3 square of values in thousandths."""
    g = _grid(spark, sf_dir).withColumn("k", F.floor(F.col("z") * 1000).cast("double"))
    return raster.blurred(g, F.col("k")).filter("v is not null").select("image", "r", "c", F.round("v", 6).alias("v"))


def edge_margin(spark, sf_dir):
    """Cells that stay two cells clear of any that isn't positive or lies outside."""
    g = _grid(spark, sf_dir).withColumn("m", (F.col("z") > -0.2).cast("int"))
    return raster.eroded(g, F.col("m"), 2).filter("v = 1").select("image", "r", "c")


def robust_threshold(spark, sf_dir):
    """Rise above a face's plane that counts: four robust spreads of the lower half, 0.28 at least."""
    return raster.rise_thresholds(_grid(spark, sf_dir), F.col("z") * 4).select("image", F.round("threshold", 6).alias("threshold"))


def raster_components(spark, sf_dir):
    """Eight-neighbour components of cells above 0.1, by their first cell."""
    out = raster.components(_grid(spark, sf_dir).filter("z > 0.1"))
    return out.select("image", "r", "c", (F.col("component.r") * 8 + F.col("component.c")).alias("first_cell"))


def raster_mosaic(spark, sf_dir):
    """Grids as tiles on a common lattice: the first tile with a value wins."""
    g = _grid(spark, sf_dir)
    rank, step = F.col("image"), F.col("image") % 50
    tiles = g.select(rank.alias("rank"), (F.col("r") + F.floor(step / 10) * 4).cast("int").alias("r"), (F.col("c") + (step % 10) * 4).cast("int").alias("c"), F.when(F.col("z") > -0.1, F.col("z")).otherwise(F.lit(float("nan"))).alias("z"))
    return raster.mosaic(tiles)


def plane_least_squares(spark, sf_dir):
    """The least-squares plane of each grid, from sums alone."""
    return raster.plane_fits(_grid(spark, sf_dir)).select("image", *(F.round(c, 6).alias(c) for c in ("a", "b", "z0", "rmse")), "n")


def plane_consensus(spark, sf_dir):
    """The plane that most cells of each grid lie on, by seeded consensus."""
    return raster.consensus_planes(_grid(spark, sf_dir))


def raised_cells(spark, sf_dir):
    """Cells above their face's plane by more than its threshold, counted; the ten largest counts."""
    g = _grid(spark, sf_dir)
    high = raster.above(g, raster.plane_fits(g), raster.rise_thresholds(g, F.col("z")))
    parts = high.groupBy("image").agg(F.count("*").alias("cells")).select(F.col("image").alias("id"), (F.col("image") % 5).alias("grp"), "cells")
    return raster.largest(parts, "grp", "cells", 2).select("grp", "id", "cells", "place")


def rasterised_parts(spark, sf_dir):
    """Cells whose centres lie in a triangle with a hole: as many as the even-odd rule says."""
    p = table(spark, sf_dir, "part")
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    n, low, high = 3 + F.col("p_size") % 6, F.lit(0.75), F.lit(1.75)
    rings = F.array(F.array(pt(low, low), pt(low, high), pt(high, high), pt(high, low)), F.array(pt(F.lit(0.25), F.lit(0.25)), pt(n + 0.25, F.lit(0.25)), pt(F.lit(0.25), n + 0.25)))
    polygons = p.select(F.col("p_partkey").alias("id"), rings.alias("rings"))
    grid = p.select(F.col("p_partkey").alias("id"), F.lit(9).alias("rows"), F.lit(9).alias("columns"))
    return raster.rasterised(polygons, grid).groupBy("id").agg(F.count("*").alias("cells"))


def local_background(spark, sf_dir):
    """Mean of the 7 x 7 square around each cell, mirrored at the image's edges."""
    g = _grid(spark, sf_dir).withColumn("k", F.floor(F.col("z") * 1000).cast("double"))
    return raster.local_mean(g, F.col("k"), raster.background_reach(2.0)).select("image", "r", "c", F.round("v", 6).alias("v"))


QUERIES = {f.__name__: f for f in (local_background, raster_morphology, raster_blur, edge_margin, robust_threshold, raster_components, raster_mosaic, plane_least_squares, plane_consensus, raised_cells, rasterised_parts)}

_AROUND = "g a JOIN g b ON a.image = b.image AND abs(a.r - b.r) <= {0} AND abs(a.c - b.c) <= {0}"
_FIT = """sums AS (SELECT image, count(*)::DOUBLE AS n, sum(c) AS x, sum(r) AS y, sum(z) AS z, sum(c * c) AS xx, sum(r * r) AS yy, sum(c * r) AS xy, sum(c * z) AS xz, sum(r * z) AS yz, sum(z * z) AS zz FROM g GROUP BY image),
cen AS (SELECT image, n, x, y, z, xx - x * x / n AS cxx, yy - y * y / n AS cyy, xy - x * y / n AS cxy, xz - x * z / n AS cxz, yz - y * z / n AS cyz, zz - z * z / n AS czz FROM sums),
fit AS (SELECT *, (cxz * cyy - cyz * cxy) / (cxx * cyy - cxy * cxy) AS a, (cyz * cxx - cxz * cxy) / (cxx * cyy - cxy * cxy) AS b FROM cen)"""
_RISE = """half AS (SELECT image, quantile_cont(v, 0.5) AS mid FROM vals GROUP BY image),
low AS (SELECT v.image, v FROM vals v JOIN half h ON v.image = h.image WHERE v <= mid),
centre AS (SELECT image, quantile_cont(v, 0.5) AS m, count(*) AS n FROM low GROUP BY image),
rise AS (SELECT l.image, CASE WHEN any_value(n) < 8 THEN 0.28::DOUBLE ELSE greatest(0.28::DOUBLE, 4 * 1.4826::DOUBLE * quantile_cont(abs(v - m), 0.5)) END AS threshold FROM low l JOIN centre c ON l.image = c.image GROUP BY l.image)"""
SQL = {
    "raster_morphology": f"""WITH g AS (SELECT *, (z > 0)::INTEGER AS m FROM ({RASTER_SQL})), e AS (SELECT a.image, a.r, a.c, any_value(a.m) AS m, min(b.m) AS eroded, max(b.m) AS dilated FROM {_AROUND.format(1)} GROUP BY ALL)
SELECT a.image, a.r, a.c, any_value(a.m) AS m, any_value(a.eroded) AS eroded, min(b.dilated) AS closed FROM {_AROUND.format(1).replace("g a", "e a").replace("g b", "e b")} GROUP BY a.image, a.r, a.c""",
    "raster_blur": f"WITH g AS (SELECT *, floor(z * 1000) AS k FROM ({RASTER_SQL})) SELECT a.image, a.r, a.c, round(sum(b.k) / 9, 6) AS v FROM {_AROUND.format(1)} GROUP BY ALL HAVING count(*) = 9",
    "edge_margin": f"WITH g AS (SELECT *, (z > -0.2)::INTEGER AS m FROM ({RASTER_SQL})) SELECT a.image, a.r, a.c FROM {_AROUND.format(2)} GROUP BY ALL HAVING min(b.m) = 1",
    "robust_threshold": f"WITH vals AS (SELECT image, z * 4 AS v FROM ({RASTER_SQL})), {_RISE} SELECT image, round(threshold, 6) AS threshold FROM rise",
    "raster_components": f"""WITH RECURSIVE g AS (SELECT image, r, c FROM ({RASTER_SQL}) WHERE z > 0.1),
reach AS (SELECT image, r, c, r * 8 + c AS k FROM g UNION SELECT a.image, b.r, b.c, a.k FROM reach a JOIN g b ON a.image = b.image AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1)
SELECT image, r, c, min(k) AS first_cell FROM reach GROUP BY image, r, c""",
    "raster_mosaic": f"""WITH t AS (SELECT image, r + (image % 50) // 10 * 4 AS r, c + image % 10 * 4 AS c, z FROM ({RASTER_SQL}) WHERE z > -0.1)
SELECT r::INTEGER AS r, c::INTEGER AS c, arg_min(z, image) AS z FROM t GROUP BY ALL""",
    "plane_least_squares": f"WITH g AS ({RASTER_SQL}), {_FIT} SELECT image, round(a, 6) AS a, round(b, 6) AS b, round((z - a * x - b * y) / n, 6) AS z0, round(sqrt(greatest(czz - a * cxz - b * cyz, 0) / n), 6) AS rmse, n::BIGINT AS n FROM fit",
    "raised_cells": f"""WITH g AS ({RASTER_SQL}), vals AS (SELECT image, z AS v FROM g), {_FIT}, {_RISE},
high AS (SELECT g.image, count(*) AS cells FROM g JOIN fit f ON g.image = f.image JOIN rise t ON g.image = t.image WHERE g.z - f.a * g.c - f.b * g.r - (f.z - f.a * f.x - f.b * f.y) / f.n > threshold GROUP BY g.image)
SELECT grp, id, cells, place FROM (SELECT image % 5 AS grp, image AS id, cells, row_number() OVER (PARTITION BY image % 5 ORDER BY cells DESC, image)::INTEGER AS place FROM high) WHERE place <= 2""",
    "rasterised_parts": """WITH p AS (SELECT p_partkey AS id, 3 + p_size % 6 AS n FROM part), k AS (SELECT unnest(range(9)) + 0.5::DOUBLE AS v)
SELECT id, count(*) AS cells FROM p, k x, k y WHERE x.v > 0.25 AND y.v > 0.25 AND x.v < 0.25 + n - (y.v - 0.25) AND NOT (x.v = 1.5 AND y.v = 1.5) GROUP BY id""",
    "local_background": f"""WITH g AS (SELECT image, r, c, floor(z * 1000) AS k FROM ({RASTER_SQL})), d AS (SELECT unnest(range(-3, 4)) AS d),
spot AS (SELECT p, q, CASE WHEN p + d < 0 THEN -(p + d) WHEN p + d > 7 THEN 14 - p - d ELSE p + d END AS pr, CASE WHEN q + e < 0 THEN -(q + e) WHEN q + e > 7 THEN 14 - q - e ELSE q + e END AS pc
  FROM (SELECT unnest(range(8)) AS p), (SELECT unnest(range(8)) AS q), d, (SELECT d AS e FROM d))
SELECT a.image, a.r, a.c, round(sum(b.k) / 49, 6) AS v FROM g a JOIN spot ON a.r = p AND a.c = q JOIN g b ON b.image = a.image AND b.r = pr AND b.c = pc GROUP BY a.image, a.r, a.c""",
}
