"""Rasters as long tables (image, r, c, z): neighbourhoods by windows, statistics, components, planes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solarweave.operators.components import connected_components
from solarweave.storage import joined_back, stored

#: Fixed values of the height rules.
LEAST_RISE, SIGMAS, TO_SIGMA, LEAST_CELLS = 0.28, 4.0, 1.4826, 8
TOLERANCE, TRIALS, FIT_SEED, FIT_CELLS = 0.25, 200, 20260908, 12
#: Cells that a rasteriser holds together.
MOST_CELLS = 1 << 20


def cells(images: DataFrame, key: str, values: str, columns: int) -> DataFrame:
    """(image, r, c, z) of images kept as arrays, row by row."""
    out = images.select(F.col(key).alias("image"), F.posexplode(values).alias("i", "z"))
    return out.select("image", F.floor(F.col("i") / columns).cast("int").alias("r"), (F.col("i") % columns).cast("int").alias("c"), F.col("z").cast("double").alias("z"))


def _separable(raster: DataFrame, value: Column, reach: int, how) -> DataFrame:
    """how over a square of side 2 reach + 1, by rows and then by columns; outside cells don't count."""
    by_row = Window.partitionBy("image", "r").orderBy("c").rangeBetween(-reach, reach)
    by_column = Window.partitionBy("image", "c").orderBy("r").rangeBetween(-reach, reach)
    return raster.withColumn("v", how(value).over(by_row)).withColumn("v", how("v").over(by_column))


def eroded(raster: DataFrame, value: Column, reach: int = 1) -> DataFrame:
    """raster with v: the least value around each cell."""
    return _separable(raster, value, reach, F.min)


def dilated(raster: DataFrame, value: Column, reach: int = 1) -> DataFrame:
    return _separable(raster, value, reach, F.max)


def closed(raster: DataFrame, value: Column, reach: int = 1) -> DataFrame:
    """raster with v: dilated, then eroded."""
    return eroded(dilated(raster, value, reach), F.col("v"), reach)


def background_reach(pixels_per_metre: float, metres: float = 3.0) -> int:
    """Reach of the square of about so many metres, of an odd number of pixels, that a local mean is taken over."""
    return (round(metres * pixels_per_metre) | 1) // 2


def mirrored(raster: DataFrame, reach: int) -> DataFrame:
    """raster and reach more cells on each side of its image, mirrored at the middle of the cells at the edge."""
    size = raster.groupBy("image").agg((F.max("r") * 2).alias("__r"), (F.max("c") * 2).alias("__c"))
    out = joined_back(raster, size, "image")
    for k in "rc":
        own, end = F.col(k), F.col(f"__{k}")
        copies = F.array(own, F.when((own > 0) & (own <= reach), -own), F.when((end - own > end / 2) & (end - own <= end / 2 + reach), end - own))
        out = out.withColumn(k, F.explode(F.array_compact(copies)))
    return out.drop("__r", "__c")


def local_mean(raster: DataFrame, value: Column, reach: int) -> DataFrame:
    """raster with v: the mean over the square around each cell, mirrored beyond the image's edges."""
    own = raster.select("image", "r", "c", value.alias("__v"))
    wide = blurred(mirrored(own, reach), F.col("__v"), reach).filter("v is not null").select("image", "r", "c", "v")
    return raster.join(wide, ["image", "r", "c"])


def blurred(raster: DataFrame, value: Column, reach: int = 1) -> DataFrame:
    """raster with v: the mean of each full square; null where the square leaves the image."""
    by_row = Window.partitionBy("image", "r").orderBy("c").rangeBetween(-reach, reach)
    by_column = Window.partitionBy("image", "c").orderBy("r").rangeBetween(-reach, reach)
    side = 2 * reach + 1
    out = raster.withColumn("s", F.sum(value).over(by_row)).withColumn("n", F.count(value).over(by_row))
    out = out.withColumn("v", F.sum("s").over(by_column)).withColumn("n", F.sum("n").over(by_column))
    return out.withColumn("v", F.when(F.col("n") == side * side, F.col("v") / (side * side))).drop("s", "n")


def rise_thresholds(raster: DataFrame, value: Column) -> DataFrame:
    """(image, threshold): the larger of 0.28 and four spreads of the lower half of the values.

    The spread is the median distance from the median, by 1.4826; under eight values in the
    lower half the threshold is 0.28. Missing and NaN values don't count.
    """
    v = raster.select("image", value.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    half = v.groupBy("image").agg(F.percentile("v", F.lit(0.5)).alias("mid"))
    low = v.join(half, "image").filter("v <= mid").select("image", "v")
    centre = low.groupBy("image").agg(F.percentile("v", F.lit(0.5)).alias("centre"), F.count("*").alias("n"))
    spread = low.join(centre, "image").groupBy("image", "n").agg(F.percentile(F.abs(F.col("v") - F.col("centre")), F.lit(0.5)).alias("spread"))
    rise = F.when(F.col("n") < LEAST_CELLS, F.lit(LEAST_RISE)).otherwise(F.greatest(F.lit(LEAST_RISE), SIGMAS * TO_SIGMA * F.col("spread")))
    return spread.select("image", rise.alias("threshold"))


#: Rows and columns of a tile are 2^10; cells are labelled within tiles first.
TILE = 10


def _first_cells(tile: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each cell, a place of the first cell by row and column that it joins over eight neighbours within its tile; tile ascends."""
    side = (1 << TILE) + 2
    key = (tile * side + (r & (1 << TILE) - 1) + 1) * side + (c & (1 << TILE) - 1) + 1
    own, at, back = np.unique(key, return_index=True, return_inverse=True)
    ends = []
    for step in (1, side - 1, side, side + 1):
        there = np.minimum(np.searchsorted(own, own + step), len(own) - 1)
        met = np.flatnonzero(own[there] == own + step)
        ends.append((met, there[met]))
    a, b = (np.concatenate(v) for v in zip(*ends, strict=True))
    root = np.arange(len(own))
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return at[root[back]]


def _labelled(batches):
    """Batches of cells sorted by tile with the first cell of their part of it; a tile that goes on is kept for the next batch."""
    names, kept = ("image", "tile_r", "tile_c"), None

    def labelled(batch: pa.RecordBatch) -> pa.RecordBatch:
        tile, r, c = tiles(batch), *(pc.fill_null(batch.column(k), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in "rc")
        first = batch.column("node").take(pa.array(_first_cells(tile, r, c))) if len(r) else batch.column("node")
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("image", "r", "c", "node")), first], names=["image", "r", "c", "node", "first"])

    def tiles(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        for k in names:
            v = pc.fill_null(batch.column(k), -1).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    for batch in batches:
        if kept is not None:
            batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        if batch.num_rows:
            last = tiles(batch)
            done = int(np.searchsorted(last, last[-1]))
            kept = batch.slice(done)
            yield labelled(batch.slice(0, done))
    if kept is not None:
        yield labelled(kept)


def components(mask: DataFrame) -> DataFrame:
    """(image, r, c, component) of set cells: the first cell by row and column joined over eight neighbours.

    Cells are numbered by image, row and column in one 64-bit integer: rows and columns are
    below 2^20, images below 2^23. Repeated cells count once in the graph.

    Cells are dealt by tiles of 1,024 x 1,024 and labelled there, many tiles together. Only parts that
    touch across the edges of tiles, so of larger images alone, go through the distributed
    components that any other graph uses.
    """
    number = lambda r, c: F.shiftleft(F.col("image").cast("long"), 40) + F.shiftleft(r.cast("long"), 20) + c
    tile = lambda v: F.shiftright(v, TILE)
    n = mask.select("image", "r", "c", number(F.col("r"), F.col("c")).alias("node"), tile(F.col("r")).alias("tile_r"), tile(F.col("c")).alias("tile_c"))
    kind = {f.name: f.dataType.simpleString() for f in n.schema}
    dealt = n.repartition("image", "tile_r", "tile_c").sortWithinPartitions("image", "tile_r", "tile_c")
    done = stored(dealt.mapInArrow(_labelled, f"image {kind['image']}, r {kind['r']}, c {kind['c']}, node long, first long"), "labelled")
    last = (1 << TILE) - 1
    place = lambda k: F.col(k).bitwiseAND(F.lit(last).cast(kind[k]))
    rim = done.filter((place("r") == last) | (place("c") == last) | ((place("c") == 0) & (F.col("c") > 0)))
    steps = F.explode(F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))))).alias("d")
    near = rim.select("image", "r", "c", F.col("first").alias("a"), steps).select("image", "a", "r", "c", (F.col("r") + F.col("d.dr")).alias("to_r"), (F.col("c") + F.col("d.dc")).alias("to_c"))
    near = near.filter("to_c >= 0").filter((tile(F.col("r")) != tile(F.col("to_r"))) | (tile(F.col("c")) != tile(F.col("to_c")))).select("a", number(F.col("to_r"), F.col("to_c")).alias("node"))
    first = F.col("first")
    if not near.isEmpty():
        labels = connected_components(near.join(done.select("node", F.col("first").alias("b")), "node").select("a", "b").distinct())
        done, first = done.join(labels.withColumnRenamed("node", "first"), "first", "left"), F.coalesce("component", "first")
    part = lambda shift: F.shiftright(first, shift).bitwiseAND(F.lit((1 << 20) - 1)).cast("int")
    return done.select("image", "r", "c", F.struct("image", part(20).alias("r"), part(0).alias("c")).alias("component"))


def mosaic(tiles: DataFrame) -> DataFrame:
    """(r, c, z) of overlapping tiles (rank, r, c, z): the first tile by rank that has a value wins."""
    real = tiles.filter(F.col("z").isNotNull() & ~F.isnan("z"))
    return real.groupBy("r", "c").agg(F.min_by("z", "rank").alias("z"))


def snapped(x1: Column, y1: Column, x2: Column, y2: Column, step: float = 0.5) -> Column:
    """Struct c1, r1, c2, r2: the window of a grid of that step, north up, that holds a box; ends are beyond the last cell."""
    low, high = lambda v: F.floor(v / step).cast("long"), lambda v: F.ceil(v / step).cast("long")
    return F.struct(low(x1).alias("c1"), (-high(y2)).alias("r1"), high(x2).alias("c2"), (-low(y1)).alias("r2"))


def mosaic_windows(requests: DataFrame, tiles: DataFrame, strict: bool = True) -> DataFrame:
    """(request, r, c, z): what a mosaic of tiles (rank, r, c, z) holds in each request's window, with rows and columns from its corner.

    requests are (request, x1, y1, x2, y2) in metres; windows are snapped to the grid of half a
    metre, and the first tile by rank that has a value wins. A window of fewer than four cells,
    or without any value, raises, or is left out unless strict.
    """
    w = requests.withColumn("w", snapped(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))).select("request", "w.*").withColumn("size", (F.col("c2") - F.col("c1")) * (F.col("r2") - F.col("r1")))
    cells = w.filter("size >= 4").select("*", F.explode(F.sequence(F.col("r1"), F.col("r2") - 1)).alias("r")).select("*", F.explode(F.sequence(F.col("c1"), F.col("c2") - 1)).alias("c"))
    found = cells.join(mosaic(tiles), ["r", "c"]).select("request", (F.col("r") - F.col("r1")).alias("r"), (F.col("c") - F.col("c1")).alias("c"), "z")
    if not strict:
        return found
    missing = w.join(found.select("request").distinct(), "request", "left_anti")
    failed = F.raise_error(F.concat(F.lit("no heights for request "), F.col("request").cast("string")))
    return found.unionByName(missing.select("request", failed.cast("long").alias("r"), F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("z")))


def plane_fits(raster: DataFrame) -> DataFrame:
    """(image, a, b, z0, rmse, n) of z = a c + b r + z0 by least squares, from sums alone.

    Sums combine on the map side; fewer than three cells, or cells on a line, give null.
    """
    s = raster.filter(F.col("z").isNotNull() & ~F.isnan("z")).groupBy("image").agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col("c").cast("double")).alias("x"), F.sum(F.col("r").cast("double")).alias("y"), F.sum("z").alias("z"),
        F.sum((F.col("c") * F.col("c")).cast("double")).alias("xx"), F.sum((F.col("r") * F.col("r")).cast("double")).alias("yy"), F.sum((F.col("c") * F.col("r")).cast("double")).alias("xy"),
        F.sum(F.col("c") * F.col("z")).alias("xz"), F.sum(F.col("r") * F.col("z")).alias("yz"), F.sum(F.col("z") * F.col("z")).alias("zz"))
    n, x, y, z, xx, yy, xy, xz, yz, zz = (F.col(k) for k in ("n", "x", "y", "z", "xx", "yy", "xy", "xz", "yz", "zz"))
    cxx, cyy, cxy, cxz, cyz, czz = xx - x * x / n, yy - y * y / n, xy - x * y / n, xz - x * z / n, yz - y * z / n, zz - z * z / n
    det = cxx * cyy - cxy * cxy
    s = s.withColumn("a", F.try_divide(cxz * cyy - cyz * cxy, det)).withColumn("b", F.try_divide(cyz * cxx - cxz * cxy, det))
    s = s.withColumn("z0", (z - F.col("a") * x - F.col("b") * y) / n)
    left = czz - F.col("a") * cxz - F.col("b") * cyz
    return s.withColumn("rmse", F.sqrt(F.greatest(left, F.lit(0.0)) / n)).select("image", "a", "b", "z0", "rmse", n.cast("long").alias("n"))


def trial_picks(cells: int) -> np.ndarray:
    """Three different cells for each trial, out of so many; they depend on the number alone."""
    rng = np.random.default_rng(FIT_SEED)
    return np.stack([rng.choice(cells, 3, replace=False) for _ in range(TRIALS)])


def consensus_plane(m: np.ndarray, z: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plane, cells that lie on it, and residuals: what most cells lie on among planes through picked ones, refined on those cells.

    m has columns c, r and 1 of the cells in the order of rows and columns, z their heights.
    """
    best = np.zeros(len(z), bool)
    picks = picks[np.abs(np.linalg.det(m[picks])) >= 1e-9]
    if len(picks):
        planes = np.linalg.solve(m[picks], z[picks][..., None])[..., 0]
        near = np.abs(z - planes @ m.T) <= TOLERANCE
        best = near[near.sum(axis=1).argmax()]
    keep = best if best.sum() >= LEAST_CELLS else np.ones(len(z), bool)
    for _ in range(3):
        plane = np.linalg.lstsq(m[keep], z[keep], rcond=None)[0]
        left = z - m @ plane
        if (np.abs(left) <= TOLERANCE).sum() < LEAST_CELLS:
            break
        keep = np.abs(left) <= TOLERANCE
    return plane, keep, left


def consensus_planes(raster: DataFrame, per_bucket: int = 100_000) -> DataFrame:
    """One plane a face by seeded consensus; faces with fewer than 12 cells have none.

    Faces share buckets of about per_bucket cells, so that small ones cost no task of their
    own, and the picks for a number of cells are drawn once a task. A face must fit a task.
    """
    columns = ["image", "a", "b", "z0", "points", "inliers", "rmse"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rows, picks = pdf.sort_values(["image", "r", "c"]), [], {}
        image, m, z = pdf.image.to_numpy(), np.column_stack((pdf.c, pdf.r, np.ones(len(pdf)))).astype(float), pdf.z.to_numpy(float)
        edges = np.flatnonzero(np.diff(image)) + 1
        for a, b in zip([0, *edges], [*edges, len(z)], strict=True):
            if b - a >= FIT_CELLS:
                if b - a not in picks:
                    picks[b - a] = trial_picks(b - a)
                plane, keep, left = consensus_plane(m[a:b], z[a:b], picks[b - a])
                rows.append((image[a], *plane, b - a, int(keep.sum()), float(np.sqrt((left[keep] ** 2).mean()))))
        return pd.DataFrame(rows, columns=columns)

    own = raster.select("image", "r", "c", "z").filter(F.col("z").isNotNull() & ~F.isnan("z") & (F.abs("z") < float("inf")))
    buckets = max(1, own.count() // per_bucket)
    return own.groupBy(F.pmod(F.xxhash64("image"), F.lit(buckets)).alias("bucket")).applyInPandas(run, "image long, a double, b double, z0 double, points long, inliers long, rmse double")


def rasterised(polygons: DataFrame, grid: DataFrame) -> DataFrame:
    """Cells of each polygon (id, rings of x, y: outlines and holes in any order): whose centre lies inside by the even-odd rule.

    grid is (id, rows, columns); cell (r, c) has its centre at c + 0.5, r + 0.5.
    """
    def run(batches):
        for batch in batches:
            rings, (rows, columns) = batch.column("rings"), (batch.column(k).to_numpy(zero_copy_only=False) for k in ("height", "width"))
            count = lambda some: pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False)
            every = rings.flatten()
            size, points = count(every), every.flatten()
            p = np.column_stack([points.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y")]).astype(float)
            ends = np.cumsum(size)
            after = np.arange(1, len(p) + 1)
            after[ends[size > 0] - 1] = (ends - size)[size > 0]
            q, owner = p[after], np.repeat(np.repeat(np.arange(len(rings)), count(rings)), size)
            known = np.isfinite(p).all(axis=1) & np.isfinite(q).all(axis=1) & (p[:, 1] != q[:, 1])
            p, q, owner = p[known], q[known], owner[known]
            of = np.repeat(np.arange(len(rings)), rows)
            r = np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)
            first, edges = np.searchsorted(owner, of), np.searchsorted(owner, of, "right") - np.searchsorted(owner, of)
            cost, at = np.cumsum(columns[of] + 1 + edges), 0
            while at < len(of):
                stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + MOST_CELLS, "right")))
                line, n = of[at:stop], edges[at:stop]
                i = np.repeat(np.arange(stop - at), n)
                e = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:stop], n)
                y = r[at:stop][i] + 0.5
                hit = (p[e, 1] > y) != (q[e, 1] > y)
                i, e, y = i[hit], e[hit], y[hit]
                # a crossing turns all cells of its line whose centres are before it
                x = (q[e, 0] - p[e, 0]) * (y - p[e, 1]) / (q[e, 1] - p[e, 1]) + p[e, 0]
                wide = columns[line] + 1
                start = np.cumsum(wide) - wide
                turns = np.bincount(start[i] + np.clip(np.ceil(x - 0.5), 0, columns[line][i]).astype(np.int64), minlength=int(wide.sum()))
                before = np.cumsum(turns)
                own = np.repeat(np.arange(stop - at), wide)
                total = np.repeat(before[start + wide - 1], wide)
                found = np.flatnonzero((total - before) % 2 == 1)
                k = own[found]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(line[k])), pa.array(r[at:stop][k].astype(np.int32)), pa.array((found - start[k]).astype(np.int32))], names=["id", "r", "c"])
                at = stop

    size = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("long")
    met = polygons.join(grid, "id").select("id", "rings", size("rows").alias("height"), size("columns").alias("width"))
    return met.mapInArrow(run, f"id {met.schema['id'].dataType.simpleString()}, r int, c int")


def inside_rings(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in what rings enclose by the even-odd rule, whatever their order and direction."""
    return F.size(F.filter(rings, lambda ring: inside(ring, x, y))) % 2 == 1


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a ring of structs x, y by the even-odd rule."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, i.cast("int"))
    crosses = lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])
    hits = F.filter(F.sequence(F.lit(1), n), lambda i: crosses(at(i), at(i % n + 1)))
    return F.size(hits) % 2 == 1


def above(raster: DataFrame, fits: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Cells with residual over their face's plane, kept where it passes the face's threshold."""
    out = raster.join(fits.select("image", "a", "b", "z0"), "image").join(thresholds, "image")
    return out.withColumn("residual", F.col("z") - F.col("a") * F.col("c") - F.col("b") * F.col("r") - F.col("z0")).filter("residual > threshold")


def face_cores(raster: DataFrame) -> DataFrame:
    """raster (image, r, c, face) with core: whether all cells around are of the same face. Beyond the image nothing counts."""
    low = eroded(raster, F.coalesce("face", F.lit(-1))).withColumnRenamed("v", "__low")
    both = dilated(low, F.coalesce("face", F.lit(-1)))
    return both.withColumn("core", F.col("face").isNotNull() & (F.col("__low") == F.col("v"))).drop("__low", "v")


def largest(parts: DataFrame, group: str, area: str, n: int) -> DataFrame:
    """The n largest parts of each group, ties to the smaller id."""
    return parts.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(area), "id"))).filter(F.col("place") <= n)
