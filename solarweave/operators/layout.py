"""Module layouts on roof faces, and their totals for each building."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solarweave.functions.boxes import gap_squared

#: Module sides in metres and watts; clearances; grid origins; yield after losses.
LENGTH, WIDTH, WATTS = 1.762, 1.134, 450
SETBACK, OBSTACLE_GAP, MODULE_GAP, ROW_GAP, FLAT_ROW_GAP, FLAT_BELOW, AISLE = 0.6, 0.5, 0.1, 0.35, 1.0, 5, 0.8
AISLE_WIDER, AISLE_HIGHER = 12, 6
ORIGINS = (0.0, 0.25, 0.5, 0.75)
YIELD = 0.8
STEEPEST = 80
LEAST_AREA, GREATEST_SIDE = 1, 300
SLACK = 1e-8

#: Module width and height across the roof, and the grid's origin; the first of equal layouts wins.
LAYOUTS = [(w, h, ox, oy) for w, h in ((WIDTH, LENGTH), (LENGTH, WIDTH)) for ox in ORIGINS for oy in ORIGINS]


def usable_face(slope: Column, aspect: Column) -> Column:
    """Faces that are planned: slope and aspect known, and 0 <= slope < 80."""
    return F.coalesce(slope.isNotNull() & aspect.isNotNull() & (slope >= 0) & (slope < STEEPEST), F.lit(False))


def checked(value: Column, low: float, high: float, name: str) -> Column:
    """value where it is from low to high or null; raises elsewhere (NaN too)."""
    return F.when(value.isNull() | (value.between(low, high) & ~F.isnan(value)), value).otherwise(F.raise_error(F.concat(F.lit(f"{name} out of range: "), value.cast("string"))))


def checked_faces(faces: DataFrame, clearances: tuple[str, ...] = ()) -> DataFrame:
    """faces (w, h, slope) as they are; raises on a slope outside 0 to under 80, a side of more than 300 m and a negative clearance."""
    out = faces.withColumn("slope", checked(F.col("slope").cast("double"), 0, math.nextafter(STEEPEST, 0), "slope"))
    out = out.withColumns({c: checked(F.col(c).cast("double"), 0, GREATEST_SIDE, f"side {c}") for c in ("w", "h")})
    return out.withColumns({c: checked(F.col(c).cast("double"), 0, math.inf, f"clearance {c}") for c in clearances})


def azimuth(aspect: Column) -> Column:
    return F.pmod(aspect + 180, F.lit(360))


def _count(length: Column, side: float, step: Column, origin: float, gap: tuple[Column, Column, Column]) -> Column:
    """Grid places along one side of a rectangle whose module lies in it and outside an aisle (has, from, to)."""
    first = step * origin
    n = F.greatest(F.floor((length - side + SLACK - first) / step + 1 - 1e-12), F.lit(0))
    has, low, high = gap
    before = F.least(n, F.greatest(F.floor((low - side - first) / step + 1 + 1e-12), F.lit(0)))
    after = F.least(n, F.greatest(n - F.ceil((high - first) / step - 1e-12), F.lit(0)))
    return F.when(has, before + after).otherwise(n)


def best_layouts(faces: DataFrame) -> DataFrame:
    """Faces (w, h, slope, aspect; rectangles, aspect a multiple of 90, slope of 1 or more) with
    surface_area, usable_area, panel_count and layout of the best of the 32 layouts.

    The rectangle is taken into the roof plane, drawn in by the setback and, if large, split
    by an aisle. All layouts are counted inside the row: no rows are added and none move.
    A face under 1 square metre, or one that setbacks consume, has no panel.
    """
    across = F.col("aspect") % 180 == 0
    stretch = F.cos(F.radians("slope"))
    out = faces.withColumn("u", F.when(across, F.col("w")).otherwise(F.col("h"))).withColumn("v", F.when(across, F.col("h")).otherwise(F.col("w")) / stretch)
    out = out.withColumn("in_u", F.greatest(F.col("u") - 2 * SETBACK, F.lit(0.0))).withColumn("in_v", F.greatest(F.col("v") - 2 * SETBACK, F.lit(0.0)))
    split = (F.col("in_u") > AISLE_WIDER) & (F.col("in_v") > AISLE_HIGHER)
    fits = (F.col("w") * F.col("h") >= 1) & (F.col("in_u") > 0) & (F.col("in_v") > 0)
    gap = (split, F.col("in_u") / 2 - AISLE / 2, F.col("in_u") / 2 + AISLE / 2)
    none = (F.lit(False), F.lit(0.0), F.lit(0.0))
    row_gap = F.when(F.col("slope") < FLAT_BELOW, F.lit(max(ROW_GAP, FLAT_ROW_GAP))).otherwise(F.lit(ROW_GAP))
    per = len(ORIGINS)
    best = []
    for k, (w, h) in enumerate(((WIDTH, LENGTH), (LENGTH, WIDTH))):
        # A layout holds columns times rows, so the best origins are found for each side alone.
        columns = F.array_max(F.array(*(F.struct(_count(F.col("in_u"), w, F.lit(w + MODULE_GAP), o, gap).alias("n"), F.lit(-i).alias("i")) for i, o in enumerate(ORIGINS))))
        rows = F.array_max(F.array(*(F.struct(_count(F.col("in_v"), h, h + row_gap, o, none).alias("n"), F.lit(-i).alias("i")) for i, o in enumerate(ORIGINS))))
        out = out.withColumns({f"columns{k}": columns, f"rows{k}": rows})
        best.append(F.struct((F.col(f"columns{k}.n") * F.col(f"rows{k}.n")).alias("n"), (F.col(f"columns{k}.i") * per + F.col(f"rows{k}.i") - k * per * per).alias("i")))
    out = out.withColumn("best", F.array_max(F.array(*best)))
    usable = F.col("in_u") * F.col("in_v") - F.when(split, F.lit(AISLE) * F.col("in_v")).otherwise(0.0)
    out = out.withColumn("surface_area", F.when(F.col("w") * F.col("h") >= 1, F.col("u") * F.col("v")).otherwise(0.0)).withColumn("usable_area", F.when(fits, usable).otherwise(0.0))
    return out.withColumn("panel_count", F.when(fits, F.col("best.n")).otherwise(0).cast("long")).withColumn("layout", (-F.col("best.i")).cast("long")).drop("u", "v", "in_u", "in_v", "best", "columns0", "rows0", "columns1", "rows1")


def annual_kwh(panels: Column, irradiance: Column) -> Column:
    """Energy of a face; null where the irradiance is unknown."""
    return panels * WATTS / 1000 * irradiance * YIELD


def building_totals(faces: DataFrame) -> DataFrame:
    """Per building_id: facets, panel_count, kwp, usable_area, annual_kwh (null if any face's is unknown)."""
    energy = annual_kwh(F.col("panel_count"), F.col("irradiance"))
    total = F.when(F.count(F.when(energy.isNull(), 1)) == 0, F.sum(energy))
    return faces.groupBy("building_id").agg(F.count("*").alias("facets"), F.sum("panel_count").alias("panel_count"), F.sum("usable_area").alias("usable_area"), total.alias("annual_kwh")).withColumn("kwp", F.col("panel_count") * WATTS / 1000)


def clear_panels(panels: DataFrame, obstacles: DataFrame, key: str, gap: float = OBSTACLE_GAP, slack: float = 0.0) -> DataFrame:
    """Panels of a face that keep at least gap from every obstacle of that face.

    An anti-join by face: a panel is given up on the first obstacle that is too near.
    """
    o = obstacles.select(F.col(key).alias("o_key"), *(F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")))
    p = panels.select("*", *(F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")))
    return p.join(o, (p[key] == o.o_key) & (gap_squared("p_", "o_") < gap * gap - slack), "left_anti").drop(*(f"p_{c}" for c in ("x1", "y1", "x2", "y2")))


def image_window(extent: Column, strict: bool = False) -> Column:
    """Struct side, pixels for a roof extent in metres: at least 40 m, a 12 m margin, 0.1 m a pixel, 1800 at most.

    Over 180 m the window is null, or raises if strict.
    """
    side = F.greatest(F.lit(40.0), extent + 12)
    window = F.struct(side.alias("side"), F.least(F.lit(1800), F.ceil(side / 0.1)).cast("long").alias("pixels"))
    return F.when(side <= 180, window).otherwise(F.raise_error(F.lit("roof too large for one image")) if strict else F.lit(None))


def tile_starts(length: Column, tile: int) -> Column:
    """Starts of crops of one size with a quarter overlap; the last one always fits."""
    last = F.greatest(length - tile, F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(math.floor(tile * 0.75))), F.array(last))))
