"""Polygons of any outline as columns: repair, union, difference, common parts, growth, and unions of large groups cell by cell.

A polygon is an array of rings by the even-odd rule, a ring an array of structs x, y, closed or
not. Results are arrays of parts: polygons whose first ring is the shell (counter-clockwise),
the others its holes (clockwise). Rows with null give no part. Functions run on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solarweave.functions import overlay, overlays, unions
from solarweave.functions.boxes import ring_bounds
from solarweave.functions.overlays import Rows
from solarweave.operators.spatial import BOX, overlap_join
from solarweave.storage import stored

RINGS = "array<array<struct<x: double, y: double>>>"
PARTS = f"array<{RINGS}>"
#: Parts of this area or less are none.
TINY = 1e-8

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def _points(points: pa.Array) -> np.ndarray:
    return np.column_stack([points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")]).astype(float)


def _counts(column: pa.Array) -> np.ndarray:
    """How many values each list of an Arrow array has; those of flatten(), so none for null."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _rows(n: int, rings: pa.Array, row: np.ndarray, polygon: np.ndarray) -> Rows:
    """Rows of an Arrow array of rings, each with its row and polygon."""
    return Rows(n, _points(rings.flatten()), np.concatenate(([0], np.cumsum(_counts(rings)))), row, polygon)


def rings_of(column: pa.Array) -> Rows:
    """The one polygon of each row of an Arrow array of RINGS; none where it is null."""
    row = np.repeat(np.arange(len(column)), _counts(column))
    return _rows(len(column), column.flatten(), row, np.zeros(len(row), np.int64))


def polygons_of(column: pa.Array) -> Rows:
    """The polygons of each row of an Arrow array of PARTS."""
    polygons, count = column.flatten(), _counts(column)
    number = np.arange(len(polygons)) - np.repeat(np.cumsum(count) - count, count)
    rings = _counts(polygons)
    return _rows(len(column), polygons.flatten(), np.repeat(np.repeat(np.arange(len(column)), count), rings), np.repeat(number, rings))


def _both(a: pa.Array, b: pa.Array) -> Rows:
    """Two polygons a row; neither where the first has no ring."""
    first, second = rings_of(a), rings_of(b)
    some = np.isin(second.row, first.row)
    size = np.diff(second.starts)
    second = Rows(second.n, second.xy[np.repeat(some, size)], np.concatenate(([0], np.cumsum(size[some]))), second.row[some], second.polygon[some])
    return overlays.merged(first, second)


#: What is taken of (n, polygons) flags: the first polygon, any, the first with another, the first alone, an odd number.
FIRST: overlays.Rule = lambda held: held[:, 0]
ANY: overlays.Rule = lambda held: held.any(axis=1)
BOTH: overlays.Rule = lambda held: held[:, 0] & held[:, 1:].any(axis=1)
ALONE: overlays.Rule = lambda held: held[:, 0] & ~held[:, 1:].any(axis=1)
ODD: overlays.Rule = lambda held: held.sum(axis=1) % 2 == 1


def _offsets(counts: list[int]) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int32))


def parts_array(rows: list[list[overlay.Part]]) -> pa.Array:
    """Rows of parts as an Arrow array of PARTS."""
    parts = [p for row in rows for p in row]
    rings = [r for p in parts for r in p]
    xy = np.concatenate(rings) if rings else np.zeros((0, 2))
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], fields=list(_POINT))
    inner = pa.ListArray.from_arrays(_offsets([len(r) for r in rings]), points)
    return pa.ListArray.from_arrays(_offsets([len(row) for row in rows]), pa.ListArray.from_arrays(_offsets([len(p) for p in parts]), inner))


def repaired(rings: Column) -> Column:
    """Parts of a polygon whose rings may cross themselves and each other; a bow-tie has two."""

    @F.arrow_udf(PARTS)
    def run(column: pa.Array) -> pa.Array:
        return parts_array(overlays.overlays(rings_of(column), FIRST, TINY))

    return run(rings)


def united(polygons: Column) -> Column:
    """Parts of what any of an array of polygons holds."""

    @F.arrow_udf(PARTS)
    def run(column: pa.Array) -> pa.Array:
        return parts_array(overlays.overlays(polygons_of(column), ANY))

    return run(polygons)


def _of_two(rule: overlays.Rule, a: Column, b: Column) -> Column:
    @F.arrow_udf(PARTS)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return parts_array(overlays.overlays(_both(a, b), rule))

    return run(a, b)


def common(a: Column, b: Column) -> Column:
    """Parts that two polygons share."""
    return _of_two(BOTH, a, b)


def odd(a: Column, b: Column) -> Column:
    """Parts that one of two polygons holds alone; nothing where the first has no ring."""
    return _of_two(ODD, a, b)


def without(rings: Column, others: Column) -> Column:
    """Parts of a polygon that none of an array of others holds."""

    @F.arrow_udf(PARTS)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return parts_array(overlays.overlays(overlays.merged(rings_of(a), polygons_of(b)), ALONE))

    return run(rings, others)


def shared_areas(a: Column, b: Column) -> Column:
    """Struct whole, both, first, either of two polygons: the areas of their union, common part, what the first holds alone, and what one holds alone.

    One arrangement serves all four. All are 0 where the first has no ring.
    """

    @F.arrow_udf("struct<whole: double, both: double, first: double, either: double>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(v) for v in overlays.areas(_both(a, b), ANY, BOTH, ALONE, ODD)], names=["whole", "both", "first", "either"])

    return run(a, b)


def resized(parts: Column, width: float) -> Column:
    """parts grown by width, or shrunk by it if it is negative; corners that bend away become arcs."""
    change = overlay.grown if width > 0 else overlay.shrunk

    @F.arrow_udf(PARTS)
    def run(column: pa.Array) -> pa.Array:
        rows = polygons_of(column)
        return parts_array([change(rows.polygons(k), abs(width)) for k in range(rows.n)])

    return run(parts)


def smallest_rectangle(points: Column) -> Column:
    """Struct long, short, angle (degrees of the longer side from the x axis, 0 to under 180) of the smallest rectangle around a ring; null around none."""

    @F.arrow_udf("struct<long: double, short: double, angle: double>")
    def run(column: pa.Array) -> pa.Array:
        long, short, angle = overlays.smallest_rectangles(_points(column.flatten()), np.concatenate(([0], np.cumsum(_counts(column))))).T
        none = pa.array(np.isnan(long))
        return pa.StructArray.from_arrays([pa.array(v) for v in (long, short, np.degrees(angle) % 180)], names=["long", "short", "angle"], mask=none)

    return run(points)


def signed_area(ring: Column) -> Column:
    """Area of a ring, positive if counter-clockwise."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, i.cast("int"))
    first = F.get(ring, F.lit(0))
    term = lambda i: (at(i)["x"] - first["x"]) * (at(i % n + 1)["y"] - first["y"]) - (at(i % n + 1)["x"] - first["x"]) * (at(i)["y"] - first["y"])
    return F.when(n >= 3, F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0.0), lambda s, t: s + t) / 2).otherwise(F.lit(0.0))


def part_area(part: Column) -> Column:
    """Area of a part: its shell less its holes."""
    return F.aggregate(F.transform(part, signed_area), F.lit(0.0), lambda s, t: s + t)


def parts_area(parts: Column) -> Column:
    return F.aggregate(F.transform(parts, part_area), F.lit(0.0), lambda s, t: s + t)


def exploded(df: DataFrame, parts: str = "parts", least: float = TINY) -> DataFrame:
    """df with a row for each part that covers more than least, as part, with its place n (from 0) and its area."""
    out = df.select(*(c for c in df.columns if c != parts), F.posexplode(parts).alias("n", "part"))
    return out.withColumn("area", part_area(F.col("part"))).filter(F.col("area") > least)


def bounded(df: DataFrame, rings: str = "rings") -> DataFrame:
    """df with the box x1, y1, x2, y2 around its rings; rows without a point have null there."""
    return df.withColumn("__b", ring_bounds(F.flatten(rings))).withColumns({c: F.col(f"__b.{c}") for c in BOX}).drop("__b")


def clipped(left: DataFrame, right: DataFrame, size: float, on: tuple[str, ...] = (), least: float = 0.0) -> DataFrame:
    """Pairs of polygons (column rings) that share more than least: left's and right's columns as a_ and b_, parts, and area.

    Pairs meet by on, and by the grid cells of their boxes where on is empty or a key has many; only those whose boxes overlap
    are overlaid. right is written first, as it is counted and joined; it is not broadcast by the size of its file, in
    which equal rings take no room.
    """
    right = stored(bounded(right), "right").hint("merge")
    met = overlap_join(bounded(left), right, size, on=on, counted=bool(on)).drop(*(f"{p}{c}" for p in ("a_", "b_") for c in BOX), "overlap")

    @F.arrow_udf(f"struct<parts: {PARTS}, area: double>")
    def shared(a: pa.Array, b: pa.Array) -> pa.Array:
        parts = overlays.overlays(_both(a, b), BOTH)
        return pa.StructArray.from_arrays([parts_array(parts), pa.array(overlays.measured(parts))], names=["parts", "area"])

    # a deterministic one is run twice, for the filter (even before the join) and for the columns
    met = met.withColumn("__shared", shared.asNondeterministic()(F.col("a_rings"), F.col("b_rings"))).filter(F.col("__shared.area") > least)
    return met.withColumns({c: F.col(f"__shared.{c}") for c in ("parts", "area")}).drop("__shared")


#: Polygons of a key from which it is dealt to cells; rows that are dealt at once, and polygons of an open cell that are held before what lies behind is added up.
MANY, MOST_DEALT, MOST_HELD = 4096, 1 << 16, 1 << 15


def _key_fields(df: DataFrame, keys: tuple[str, ...]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def _outlines(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, Rows]:
    """Rows of a batch whose rings are polygons, and these; a polygon that is null or has a null ring, no point, or a point that isn't finite is none."""
    rings = batch.column("rings")
    rows = rings_of(rings)
    size = np.diff(rows.starts)
    none = np.bincount(rows.row, size, rows.n) == 0
    none[np.repeat(rows.row, size)[~np.isfinite(rows.xy).all(axis=1)]] = True
    if rings.flatten().null_count:
        none[rows.row[rings.flatten().is_null().to_numpy(zero_copy_only=False)]] = True
    if not none.any():
        return batch, rows
    batch = batch.filter(pa.array(~none))
    return batch, rings_of(batch.column("rings"))


def _boxes(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of polygons that all have points."""
    first = np.searchsorted(rows.row, np.arange(rows.n))
    return np.minimum.reduceat(rows.xy, rows.starts[first]), np.maximum.reduceat(rows.xy, rows.starts[first])


def _different(rows: Rows) -> np.ndarray:
    """Whether each polygon, all with points, is the first with its rings."""
    ring, seen, out = np.searchsorted(rows.row, np.arange(rows.n + 1)), set(), np.zeros(rows.n, bool)
    at = rows.starts[ring]
    for k in range(rows.n):
        key = (rows.xy[at[k] : at[k + 1]].tobytes(), np.diff(rows.starts[ring[k] : ring[k + 1] + 1]).tobytes())
        out[k] = key not in seen
        seen.add(key)
    return out


def _in_cells(polygons: DataFrame, keys: tuple[str, ...], size: float) -> DataFrame:
    """(keys, cell_x, cell_y, x1, rings): polygons once for each grid cell that their box touches, with their least x."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in map(_outlines, batches):
            if not batch.num_rows:
                continue
            low, high = _boxes(rows)
            cell, last = (np.floor(v / size).astype(np.int64) for v in (low, high))
            across, down = (last - cell + 1).T
            total = np.cumsum(across * down)
            for at in range(0, int(total[-1]), MOST_DEALT):
                number = np.arange(at, min(at + MOST_DEALT, int(total[-1])))
                k = np.searchsorted(total, number, "right")
                number -= (total - across * down)[k]
                own = batch.take(pa.array(k))
                columns = [pa.array(v) for v in (cell[k, 0] + number % across[k], cell[k, 1] + number // across[k], low[k, 0])]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in keys), *columns, own.column("rings")], names=[*keys, "cell_x", "cell_y", "x1", "rings"])

    return polygons.mapInArrow(run, f"{_key_fields(polygons, keys)}cell_x long, cell_y long, x1 double, rings {RINGS}")


def _group_areas(polygons: DataFrame, keys: tuple[str, ...], by: list[str], size: float | None = None) -> DataFrame:
    """(keys, part): what the polygons (rings) of each group by by cover, with size of its cell (cell_x, cell_y) alone.

    Rows of a group lie together, those of a cell in order of x1. Of a cell that doesn't end, what lies left of the last polygon is added up and let go,
    and of polygons with the same rings one stays.
    """

    def swept(rows: Rows, corners: tuple[np.ndarray, np.ndarray], cells: pa.RecordBatch, starts: np.ndarray, left: float, right: float = np.inf) -> np.ndarray:
        """Areas of groups that start at starts; of the first one only between left and right."""
        if size:
            low = np.column_stack([cells.column(c).to_numpy()[starts] for c in ("cell_x", "cell_y")]) * size
            windows = np.column_stack((low, low + size))
            windows[0, 0], windows[0, 2] = max(windows[0, 0], left), min(windows[0, 2], right)
        else:
            windows = np.column_stack((np.minimum.reduceat(corners[0], starts), np.maximum.reduceat(corners[1], starts)))
        ring = np.repeat(np.arange(len(rows.row)), np.diff(rows.starts))
        edges = np.column_stack((rows.xy, rows.xy[overlays.following(rows.starts, len(rows.xy))]))
        return unions.covered(edges, rows.row[ring], np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.n))), windows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the open group
        done, line, count, most = 0.0, -np.inf, 0, MOST_HELD

        def ended(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            rows = rings_of(batch.column("rings"))
            part = swept(rows, _boxes(rows), batch, starts, line)
            part[0] += done
            first = batch.take(pa.array(starts))
            return pa.RecordBatch.from_arrays([*(first.column(k) for k in keys), pa.array(part)], names=[*keys, "part"])

        for batch in (b for b, _ in map(_outlines, batches) if b.num_rows):
            new = np.zeros(batch.num_rows, bool)
            new[0] = not held
            for k in by:
                before = held[-1].column(k).slice(held[-1].num_rows - 1) if held else batch.column(k).slice(0, 1)
                number = pa.concat_arrays([before, batch.column(k)]).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new |= number[1:] != number[:-1]
            starts = np.flatnonzero(new)
            if len(starts):
                every = pa.concat_batches([*held, batch.slice(0, int(starts[-1]))])
                if every.num_rows:
                    yield ended(every, np.unique(np.concatenate(([0], starts[:-1] + count))))
                held, count, done, line = [batch.slice(int(starts[-1]))], batch.num_rows - int(starts[-1]), 0.0, -np.inf
                most = MOST_HELD
            else:
                held.append(batch)
                count += batch.num_rows
            if size and count > most:
                every = pa.concat_batches(held)
                rows = rings_of(every.column("rings"))
                corners = _boxes(rows)
                to = max(line, min(float(corners[0][-1, 0]), (every.column("cell_x")[0].as_py() + 1) * size))
                done += float(swept(rows, corners, every, np.array([0]), line, to)[0])
                line = to
                # the last one stays, so that the cell is known
                held = [every.filter(pa.array((corners[1][:, 0] > line) & _different(rows) | (np.arange(count) == count - 1)))]
                count = held[0].num_rows
                most = max(MOST_HELD, 2 * count)
        if held:
            yield ended(pa.concat_batches(held), np.array([0]))

    return polygons.repartition(*by).sortWithinPartitions(*by, *(["x1"] if size else [])).mapInArrow(run, f"{_key_fields(polygons, keys)}part double")


def union_area(polygons: DataFrame, *keys: str, size: float) -> DataFrame:
    """(keys, union_area) of the polygons (rings) of each key.

    A key's polygons lie together, and many keys are swept together in numpy. Polygons of a key
    that has very many are dealt to the grid cells that their boxes touch, and each cell adds up what they
    cover of it: so such a key is many small groups, and no task holds more than a cell's.
    """
    own, same = polygons.select(*keys, "rings"), lambda a, b: reduce(and_, (a[k].eqNullSafe(b[k]) for k in keys))
    large = stored(own.groupBy(*keys).count().filter(F.col("count") > MANY).select(*keys), "large")
    if large.isEmpty():
        return _group_areas(own, keys, list(keys)).withColumnRenamed("part", "union_area")
    few = _group_areas(own.join(large, same(own, large), "left_anti"), keys, list(keys))
    many = _group_areas(_in_cells(own.join(large, same(own, large), "left_semi"), keys, size), keys, [*keys, "cell_x", "cell_y"], size)
    return few.unionByName(many.groupBy(*keys).agg(F.sum("part").alias("part"))).withColumnRenamed("part", "union_area")


def _listed(rows: DataFrame, key: str, rings: str) -> DataFrame:
    """(key, others): the polygons (rings) of each key, which is never null, as one array.

    Rows of a key lie together, so an array is filled as they come, and only the open key's are held.
    """
    rows = rows.select(key, rings)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the open key

        def arrays(every: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            others = pa.ListArray.from_arrays(pa.array(np.append(starts, every.num_rows).astype(np.int32)), every.column(rings))
            return pa.RecordBatch.from_arrays([every.column(key).take(pa.array(starts)), others], names=[key, "others"])

        for batch in (b for b in batches if b.num_rows):
            before = held[-1].column(key).slice(held[-1].num_rows - 1) if held else batch.column(key).slice(0, 1)
            number = pa.concat_arrays([before, batch.column(key)]).dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(number[1:] != number[:-1])
            if not len(starts):
                held.append(batch)
                continue
            count = sum(b.num_rows for b in held)
            every = pa.concat_batches([*held, batch.slice(0, int(starts[-1]))])
            yield arrays(every, np.unique(np.concatenate(([0], starts[:-1] + count))))
            held = [batch.slice(int(starts[-1]))]
        if held:
            yield arrays(pa.concat_batches(held), np.array([0]))

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, f"{_key_fields(rows, (key,))}others {PARTS}")


def free_parts(polygons: DataFrame, covers: DataFrame, key: str, size: float) -> DataFrame:
    """(key, parts, area): what is left of each key's one polygon (rings) without its covers (key, rings).

    Only covers whose boxes overlap the polygon's reach its row. A polygon and what lies on it
    must fit one row, as a roof and its obstacles do.
    """
    own = stored(bounded(polygons.select(key, "rings")), "polygons")
    met = overlap_join(own, bounded(covers.select(key, "rings")), size, on=(key,), counted=True)
    met = _listed(met.select(F.col(f"a_{key}").alias("__k"), "b_rings"), "__k", "b_rings")
    left = own.join(met, F.col(key) == F.col("__k"), "left").withColumn("parts", without(F.col("rings"), F.coalesce("others", F.array().cast(PARTS))))
    return left.select(key, "parts", parts_area(F.col("parts")).alias("area"))
