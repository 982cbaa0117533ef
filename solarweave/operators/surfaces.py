"""Faces, masks and edges: ownership, obstacles from heights, windows from colour, registration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solarweave.functions.boxes import ring_area
from solarweave.operators.packing import TASKS_A_CORE
from solarweave.operators.raster import TO_SIGMA, background_reach, closed, eroded, inside, local_mean
from solarweave.operators.spatial import BOX, common_part, overlap_join, union_area
from solarweave.storage import joined_back

#: Rules of obstacles and of windows, and the strongest edge.
CELL_SIDE, CELL_AREA, LEAST_OBSTACLE, OBSTACLE_SHARE, CHIMNEY_AREA, THIN, MOST_OBSTACLES = 0.5, 0.25, 0.35, 0.5, 2.5, 0.7, 40
LEAST_DROP, LEAST_DROP_AREA, DROP_SHARE = 1.5, 4.0, 0.95
WINDOW_CONTRAST, WINDOW_SIGMAS, WINDOW_LEAST, WINDOW_MOST, ASPECT_LEAST, ASPECT_MOST, FILL_LEAST = 8.0, 3.0, 0.25, 6.0, 0.3, 3.4, 0.55
EDGE_MARGIN, LEAST_CORE, WINDOW_GROW, MOST_WINDOWS = 0.4, 64, 0.2, 60
EDGE_MOST = 100.0


def uncovered_area(boxes: DataFrame, covers: DataFrame, key: str, size: float) -> DataFrame:
    """(key, area, free_area) of one box for each key less the union of its covers (key and box)."""
    clip = common_part(overlap_join(boxes.select(key, *BOX), covers.select(key, *BOX), size, on=(key,)), F.col(f"a_{key}").alias(key))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return boxes.select(key, area.alias("area")).join(union_area(clip, key, size=size), key, "left").select(key, "area", (F.col("area") - F.coalesce("union_area", F.lit(0.0))).alias("free_area"))


def visible_area(faces: DataFrame, building: str, order: str, size: float) -> DataFrame:
    """(order, area, free_area): what earlier faces of the building leave of each face. Only faces that share a grid cell meet."""
    own = faces.select(building, order, *BOX)
    met = overlap_join(own, own, size, on=(building,)).filter(F.col(f"b_{order}") < F.col(f"a_{order}"))
    lost = union_area(common_part(met, F.col(f"a_{order}").alias(order)), order, size=size, once=True)
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return own.select(order, area.alias("area")).join(lost, order, "left").select(order, "area", (F.col("area") - F.coalesce("union_area", F.lit(0.0))).alias("free_area"))


def even_odd_area(rings: Column) -> Column:
    """Area that rings (arrays of x, y, which don't cross) enclose by the even-odd rule.

    Neither their order nor their direction counts: a ring inside an odd number of others is a hole.
    """
    def signed(ring, i):
        depth = F.size(F.filter(rings, lambda other, j: (i != j) & inside(other, ring[0]["x"], ring[0]["y"])))
        return F.when(depth % 2 == 0, ring_area(ring)).otherwise(-ring_area(ring))

    return F.aggregate(F.transform(rings, signed), F.lit(0.0), lambda s, x: s + x)


def raised_and_dropped(raster: DataFrame, fits: DataFrame, thresholds: DataFrame) -> DataFrame:
    """raster (image, face, r, c, z, core) with residual, raised and dropped (0 or 1) against the plane of its face.

    fits and thresholds are by image and face. Only the core of a face is judged: a cell on a
    ridge stands proud of both its faces. Missing heights are neither.
    """
    out = raster.join(fits, ["image", "face"], "left").join(thresholds, ["image", "face"], "left")
    out = out.withColumn("residual", F.col("z") - F.col("a") * F.col("c") - F.col("b") * F.col("r") - F.col("z0"))
    judged = F.col("core") & F.col("residual").isNotNull() & ~F.isnan("residual")
    mark = lambda c: F.coalesce(judged & c, F.lit(False)).cast("int")
    return out.withColumn("raised", mark(F.col("residual") > F.col("threshold"))).withColumn("dropped", mark(F.col("residual") < -LEAST_DROP)).select("image", "r", "c", "face", "residual", "raised", "dropped")


def obstacles(components: DataFrame, below: bool = False, most: int = MOST_OBSTACLES) -> DataFrame:
    """Obstacles of closed components (image, component, r, c, depth, roof_area): cells, area, height, kind and place by area.

    Each cell is a quarter of a square metre. Raised parts have 0.35 square metres at least and
    at most half of the roof, dropped ones (below) 4 and 0.95 of it; parts whose enclosing box
    is thinner than 0.7 m go. Raised ones up to 2.5 square metres are chimneys, all else other
    obstacles. depth is null where a cell lacks heights; the most largest of an image stay.
    """
    out = components.groupBy("image", "component").agg(
        F.count("*").alias("cells"), (F.max("r") - F.min("r") + 1).alias("rows"), (F.max("c") - F.min("c") + 1).alias("columns"), F.max("depth").alias("height"), F.first("roof_area").alias("roof_area")
    )
    least, share = (LEAST_DROP_AREA, DROP_SHARE) if below else (LEAST_OBSTACLE, OBSTACLE_SHARE)
    out = out.withColumn("area", F.col("cells") * CELL_AREA).filter((F.col("area") >= least) & (F.col("area") <= F.col("roof_area") * share) & (F.least("rows", "columns") * CELL_SIDE >= THIN))
    kind = F.lit("other_obstacle") if below else F.when(F.col("area") <= CHIMNEY_AREA, "chimney").otherwise("other_obstacle")
    place = F.row_number().over(Window.partitionBy("image").orderBy(F.desc("area"), "component"))
    return out.withColumn("kind", kind).withColumn("place", place).filter(F.col("place") <= most).drop("roof_area")


def windows(components: DataFrame, pixels_per_metre: float, most: int = MOST_WINDOWS) -> DataFrame:
    """Roof windows among components of contrast (image, component, r, c): cells, area, fill, grown_area and place.

    A window has 0.25 to 6 square metres, an aspect from 0.3 to 3.4, and fills at least 0.55 of
    its box. Its bright part stops short of its frame, so its box grows by 0.2 m on each side;
    the most largest of an image stay.
    """
    cell, grow = 1 / pixels_per_metre**2, 2 * WINDOW_GROW * pixels_per_metre
    c = components.groupBy("image", "component").agg(F.count("*").alias("cells"), (F.max("r") - F.min("r") + 1).alias("rows"), (F.max("c") - F.min("c") + 1).alias("columns"))
    c = c.withColumn("area", F.col("cells") * cell).withColumn("aspect", F.col("columns") / F.col("rows")).withColumn("fill", F.col("cells") / (F.col("rows") * F.col("columns")))
    c = c.filter(F.col("area").between(WINDOW_LEAST, WINDOW_MOST) & F.col("aspect").between(ASPECT_LEAST, ASPECT_MOST) & (F.col("fill") >= FILL_LEAST))
    c = c.withColumn("grown_area", (F.col("rows") + grow) * (F.col("columns") + grow) * cell)
    return c.withColumn("place", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("grown_area"), "component"))).filter(F.col("place") <= most)


def contrast_hits(raster: DataFrame, pixels_per_metre: float) -> DataFrame:
    """(image, r, c, hit) of images (image, r, c, red, blue, roof): closed cells of blue contrast on the roof.

    Contrast is blue minus red less its mean over 3 m around; a cell is hit if it exceeds the
    median of the roof's core by 8 and by three robust spreads. The core stays 0.4 m clear of the
    roof's edge; an image whose core has fewer than 64 cells has no hit.
    """
    k = raster.withColumn("k", (F.col("blue") - F.col("red")).cast("double"))
    k = local_mean(k, F.col("k"), background_reach(pixels_per_metre)).withColumn("contrast", F.col("k") - F.col("v")).drop("v")
    k = eroded(k, F.col("roof").cast("int"), max(1, round(EDGE_MARGIN * pixels_per_metre))).withColumn("core", F.col("v") == 1).select("image", "r", "c", "contrast", "core")
    core = k.filter("core")
    centre = core.groupBy("image").agg(F.percentile("contrast", F.lit(0.5)).alias("centre"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_CORE)
    spread = joined_back(core, centre, "image").groupBy("image", "centre").agg(F.percentile(F.abs(F.col("contrast") - F.col("centre")), F.lit(0.5)).alias("spread"))
    least = spread.select("image", (F.col("centre") + F.greatest(F.lit(WINDOW_CONTRAST), WINDOW_SIGMAS * TO_SIGMA * F.col("spread"))).alias("least"))
    hit = joined_back(k, least, "image").withColumn("hit", (F.col("core") & (F.col("contrast") > F.col("least"))).cast("int"))
    return closed(hit, F.col("hit")).select("image", "r", "c", F.col("v").alias("hit"))


def edges(raster: DataFrame, value: str, whole: bool = False) -> DataFrame:
    """raster with gx and gy: Sobel of the 5 x 5 Gaussian, where both lie inside the image; else null.

    With whole the smoothed values are rounded, as those of an 8-bit image are.
    """

    def line(col: Column, along: str, across: str, weights: tuple[int, ...], scale: float) -> Column:
        w, half = Window.partitionBy("image", across).orderBy(along), len(weights) // 2
        return sum((F.lag(col, half - i).over(w) * k for i, k in enumerate(weights) if k), F.lit(0.0)) / scale

    smooth = raster.withColumn("s", line(F.col(value), "c", "r", (1, 4, 6, 4, 1), 16.0))
    smooth = smooth.withColumn("s", line(F.col("s"), "r", "c", (1, 4, 6, 4, 1), 16.0))
    smooth = smooth.withColumn("s", F.floor(F.col("s") + 0.5).cast("double")) if whole else smooth
    out = smooth.withColumn("dx", line(F.col("s"), "c", "r", (-1, 0, 1), 1.0)).withColumn("dy", line(F.col("s"), "r", "c", (-1, 0, 1), 1.0))
    return out.withColumn("gx", line(F.col("dx"), "r", "c", (1, 2, 1), 1.0)).withColumn("gy", line(F.col("dy"), "c", "r", (1, 2, 1), 1.0)).drop("s", "dx", "dy")


def image_edges(z: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """As edges, of one whole image: gx and gy, NaN where they leave it."""

    def line(v: np.ndarray, axis: int, weights: tuple[int, ...], scale: float) -> np.ndarray:
        half, out = len(weights) // 2, np.full(v.shape, np.nan)
        n = v.shape[axis] - 2 * half
        if n > 0:
            own = np.moveaxis(v, axis, 0)
            np.moveaxis(out, axis, 0)[half : half + n] = sum((own[i : i + n] * k for i, k in enumerate(weights) if k), 0.0) / scale
        return out

    s = line(line(z, 1, (1, 4, 6, 4, 1), 16.0), 0, (1, 4, 6, 4, 1), 16.0)
    s = np.floor(s + 0.5) if whole else s
    return line(line(s, 1, (-1, 0, 1), 1.0), 0, (1, 2, 1), 1.0), line(line(s, 0, (-1, 0, 1), 1.0), 1, (1, 2, 1), 1.0)


def shift_scores(points: DataFrame, edge: DataFrame, most: int) -> DataFrame:
    """(image, dx, dy, score): mean edge strength across the outline's normals under each shift.

    points are (image, r, c, nx, ny). Each meets (2 most + 1)^2 shifts at most, and the edge
    table by an equi-join on the cell; a shift that leaves the image scores over what is inside.
    """
    shifts = F.explode(F.sequence(F.lit(-most), F.lit(most)))
    moved = points.withColumn("dx", shifts).withColumn("dy", F.explode(F.sequence(F.lit(-most), F.lit(most)))).filter(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= most * most)
    moved = moved.withColumn("r", F.col("r") + F.col("dy")).withColumn("c", F.col("c") + F.col("dx"))
    strength = F.least(F.abs(F.col("gx") * F.col("nx") + F.col("gy") * F.col("ny")), F.lit(EDGE_MOST))
    return moved.join(edge.filter("gx is not null and gy is not null"), ["image", "r", "c"]).groupBy("image", "dx", "dy").agg(F.avg(strength).alias("score"))


def best_shift(scores: DataFrame) -> DataFrame:
    """The shift of the highest score of each image; of equal scores the larger dx, then dy."""
    return scores.groupBy("image").agg(F.max(F.struct("score", "dx", "dy")).alias("b")).select("image", "b.score", "b.dx", "b.dy")


def _keep(points: np.ndarray, epsilon: float) -> np.ndarray:
    """Which points of an open line stay so that the others are within epsilon of it."""
    keep, spans = np.zeros(len(points), bool), [(0, len(points) - 1)]
    keep[[0, -1]] = True
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        d, p = points[b] - points[a], points[a + 1 : b] - points[a]
        n = np.hypot(*d)
        away = np.abs(d[0] * p[:, 1] - d[1] * p[:, 0]) / n if n else np.hypot(p[:, 0], p[:, 1])
        if away.max() > epsilon:
            m = a + 1 + int(away.argmax())
            keep[m] = True
            spans += [(a, m), (m, b)]
    return keep


def _length(points: np.ndarray) -> float:
    return float(np.hypot(*np.diff(points, axis=0).T).sum())


#: How far a line's points may lie from its simplification, in pixels, by its length: outlines of heights, of windows and of masks.
TOLERANCES = {"height": lambda length: min(0.4, 0.02 * length), "window": lambda length: max(0.5, 0.03 * length), "mask": lambda length: 0.5}


def simplified(lines: DataFrame, rule: str = "mask", per_bucket: int = 5000) -> DataFrame:
    """(id, n, x, y) of the points of each line (id, n, x, y) that a simplification by the rule for its length keeps.

    A line is one group; lines share buckets so that short ones cost no task of their own.
    """
    epsilon = TOLERANCES[rule]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kept = pdf.sort_values(["id", "n"]), []
        points, ids = pdf[["x", "y"]].to_numpy(float), pdf["id"].to_numpy()
        ends = np.flatnonzero(np.diff(ids)) + 1
        for a, b in zip([0, *ends], [*ends, len(ids)], strict=True):
            kept.append(_keep(points[a:b], epsilon(_length(points[a:b]))) if b - a > 1 else np.ones(b - a, bool))
        return pdf[np.concatenate(kept)][["id", "n", "x", "y"]]

    buckets = max(1, lines.select("id").distinct().count() // per_bucket)
    return lines.select("id", "n", "x", "y").groupBy(F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket")).applyInPandas(run, "id long, n long, x double, y double")


def outline(mask: np.ndarray) -> np.ndarray:
    """Corners of the outer outline of a mask of one part, eight-connected, along the edges of its cells."""
    full = np.pad(mask, 1)
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in np.argwhere(mask).tolist():
        for (dr, dc), a, b in (((-1, 0), (c, r), (c + 1, r)), ((0, 1), (c + 1, r), (c + 1, r + 1)), ((1, 0), (c + 1, r + 1), (c, r + 1)), ((0, -1), (c, r + 1), (c, r))):
            if not full[r + 1 + dr, c + 1 + dc]:
                after.setdefault(a, []).append(b)
    start = min(after, key=lambda p: (p[1], p[0]))
    ring, at, way = [start], start, (1, 0)
    while True:
        # Where cells touch at a corner, turn left into the next one, so that the part stays one ring.
        ahead = after[at]
        step = min(ahead, key=lambda p: ((-way[1] * (p[0] - at[0]) + way[0] * (p[1] - at[1])), -(way[0] * (p[0] - at[0]) + way[1] * (p[1] - at[1]))))
        ahead.remove(step)
        turn = (step[0] - at[0], step[1] - at[1])
        if turn == way and len(ring) > 1:
            ring.pop()
        ring.append(step)
        at, way = step, turn
        if at == start:
            return np.array(ring[:-1], float)


def filled(ring: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Cells of a grid whose centre lies in a ring by the even-odd rule."""
    y, x = np.mgrid[: shape[0], : shape[1]] + 0.5
    out = np.zeros(shape, bool)
    for p, q in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        if p[1] != q[1]:
            out ^= ((p[1] > y) != (q[1] > y)) & (x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0])
    return out


def _closed_keep(ring: np.ndarray, epsilon: float) -> np.ndarray:
    """A closed ring simplified between its first point and the one farthest from it."""
    far = int(np.hypot(*(ring - ring[0]).T).argmax())
    halves = ring[: far + 1], np.vstack((ring[far:], ring[:1]))
    return np.vstack([h[_keep(h, epsilon)][:-1] for h in halves])


def mask_polygons(parts: DataFrame, rows: int, columns: int, cls: int = 0, least: int = 3, per_bucket: int = 2000) -> DataFrame:
    """(image, line, agreement) of masks (image, part, r, c): label lines of all parts of at least that many cells, and how well they fit.

    A part's line is its class and its outline, simplified within half a cell, relative to the
    image's sides. Agreement is the share of cells that mask and filled lines have in common; it
    is 1 where both are empty. An image is one group; images share buckets, which are dealt to a stated number of tasks.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for image, own in pdf.groupby("image", sort=True):
            mask, made, lines = np.zeros((rows, columns), bool), np.zeros((rows, columns), bool), []
            for _, part in own.groupby("part", sort=True):
                cells = np.zeros((rows, columns), bool)
                cells[part.r, part.c] = True
                mask |= cells
                ring = _closed_keep(outline(cells), TOLERANCES["mask"](0.0))
                if len(part) >= least and len(ring) >= 3:
                    made |= filled(ring, mask.shape)
                    lines.append(" ".join([str(cls), *(f"{v:.7f}" for v in (ring / [columns, rows]).ravel())]))
            union = (mask | made).sum()
            out.append((image, lines, float((mask & made).sum() / union) if union else 1.0))
        return pd.DataFrame(out, columns=["image", "lines", "agreement"])

    # few bytes of much work: the number of tasks is stated, so that they aren't put together again
    tasks = TASKS_A_CORE * parts.sparkSession.sparkContext.defaultParallelism
    buckets = max(4 * tasks, parts.select("image").distinct().count() // per_bucket)
    own = parts.select("image", "part", "r", "c", F.pmod(F.xxhash64("image"), F.lit(buckets)).alias("bucket"))
    return own.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(lambda pdf: run(pdf.drop(columns="bucket")), "image long, lines array<string>, agreement double")


def every_nth(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first row of each run of n of a key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("n_", F.row_number().over(w)).filter((F.col("n_") - 1) % n == 0).drop("n_")


def compatible(names: Column, kinds: tuple[str, ...], task: Column) -> Column:
    """Whether a checkpoint can serve obstacles: it segments, knows only such kinds, and not panels alone."""
    allowed = F.array(*(F.lit(k) for k in kinds if k != "roof"))
    return (task == "segment") & (F.size(F.array_except(names, allowed)) == 0) & (F.size(F.array_except(names, F.array(F.lit("pv_installation")))) > 0)


def whole_list(rows: DataFrame, name: str, expected: int) -> DataFrame:
    """(listed, distinct) of a list of names; raises where it doesn't hold the expected number of different ones."""
    out = rows.agg(F.count("*").alias("listed"), F.count_distinct(name).alias("different"))
    return out.withColumn("different", F.when(F.col("different") == expected, F.col("different")).otherwise(F.raise_error(F.concat(F.lit("names in the list: "), F.col("different").cast("string")))))
