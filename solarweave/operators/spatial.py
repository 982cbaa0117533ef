"""Range joins on boxes by grid cells: an equi-join on the cell, then the exact predicate."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solarweave.functions.boxes import overlap
from solarweave.storage import stored

BOX = ("x1", "y1", "x2", "y2")
#: Boxes of a key up to which they meet by key alone, where keys are counted; keys of more that are told apart from the others, beyond which all go by cells.
FEW, MOST_CROWDED = 256, 10_000


def _cells(df: DataFrame, size: float, reach: float = 0.0, alone: Column | None = None) -> DataFrame:
    """df once for each grid cell that a box, widened by reach, touches; where alone holds, once, in cell 0, 0."""

    def steps(k: str) -> Column:
        cells = F.sequence(F.floor((F.col(f"{k}1") - reach) / size), F.floor((F.col(f"{k}2") + reach) / size))
        return cells if alone is None else F.when(alone, F.array(F.lit(0).cast("long"))).otherwise(cells)

    return df.withColumn("cell_x", F.explode(steps("x"))).withColumn("cell_y", F.explode(steps("y")))


def _crowded(left: DataFrame, right: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Keys (on) that hold more than FEW boxes, counted over both sides, or over the one if they are the same."""
    every = left.select(*on) if left is right else left.select(*on).unionByName(right.select(*on))
    return stored(every.na.drop().groupBy(*on).agg(F.count("*").alias("__n")).filter(F.col("__n") > FEW).select(*on), "crowded")


def overlap_join(left: DataFrame, right: DataFrame, size: float, on: tuple[str, ...] = (), left_prefix: str = "a_", right_prefix: str = "b_", counted: bool = False) -> DataFrame:
    """Pairs of boxes that share area, each once, with prefixed columns and their overlap.

    size is about a box's side. A pair that shares several cells is kept in the cell of the
    larger of the two lower corners, so no distinct is needed. on are equal in both. Boxes
    with a null corner meet nothing.

    With counted, the boxes of each key are counted first, for which both sides are read once more. Boxes of
    keys with few are then dealt once, by key alone, and not for each cell; those of crowded keys go by cells, so that
    no box meets all of a large key and its rows are dealt to several tasks.
    """
    crowded = _crowded(left, right, on) if counted and on else None
    many = 0 if crowded is None else crowded.count()
    by_key = crowded is not None and many <= MOST_CROWDED
    by_cell = many > 0 or not by_key

    def dealt(df: DataFrame, prefix: str) -> DataFrame:
        df = df.na.drop(subset=list(BOX))
        if by_cell and by_key:
            marks = F.broadcast(crowded.withColumn("__crowded", F.lit(True)))
            df = df.join(marks, list(on), "left").select(*df.columns, F.col("__crowded").isNull().alias("__alone"))
        if by_cell:
            df = _cells(df, size, alone=F.col("__alone") if by_key else None)
        return df.select(*(F.col(c).alias(f"{prefix}{c}") for c in df.columns))

    sides = (left_prefix, right_prefix)
    keys = [F.col(f"{left_prefix}{c}") == F.col(f"{right_prefix}{c}") for c in (*on, *(("cell_x", "cell_y") if by_cell else ()))]
    joined = dealt(left, left_prefix).join(dealt(right, right_prefix), keys).withColumn("overlap", overlap(*sides)).filter("overlap > 0")
    cell = lambda p, c: F.floor(F.col(f"{p}{c}") / size)
    own = []
    for k in "xy":
        home = F.floor(F.greatest(*(f"{p}{k}1" for p in sides)) / size)
        # both boxes touch the pair's cell unless a corner is no number
        touched = reduce(and_, (home.between(F.least(cell(p, f"{k}1"), cell(p, f"{k}2")), F.greatest(cell(p, f"{k}1"), cell(p, f"{k}2"))) for p in sides))
        same = home == F.col(f"{left_prefix}cell_{k}") if by_cell else None
        # both sides are asked, so that those of a join with itself keep the same columns and are shuffled once
        alone = reduce(and_, (F.col(f"{p}__alone") for p in sides))
        own.append(touched if not by_cell else F.when(alone, touched).otherwise(same) if by_key else same)
    return joined.filter(own[0] & own[1]).drop(*(f"{p}{c}" for p in sides for c in ("cell_x", "cell_y", "__alone")))


def apart_from(left: DataFrame, right: DataFrame, size: float, reach: float, on: tuple[str, ...] = (), least: float = 0.0) -> DataFrame:
    """Boxes of left that share no more than least with any box of right, one anti-join; a box with a null corner stays.

    A box of left lies in the cell of its lower corner alone, so its row is kept or dropped once,
    and none is joined back. right is dealt to all cells where the lower corner of a box that meets
    it may lie; reach is the longest side of left's boxes.
    """
    cell = lambda k: F.floor(F.col(k) / size)
    a = left.withColumn("cell_x", cell("x1")).withColumn("cell_y", cell("y1"))
    steps = lambda k: F.explode(F.sequence(F.floor((F.col(f"{k}1") - reach) / size), F.floor(F.col(f"{k}2") / size)))
    b = right.na.drop(subset=list(BOX)).withColumn("cell_x", steps("x")).withColumn("cell_y", steps("y"))
    b = b.select(*(F.col(c).alias(f"b_{c}") for c in (*on, *BOX, "cell_x", "cell_y")))
    met = overlap("", "b_") > least
    for c in (*on, "cell_x", "cell_y"):
        met = met & (F.col(c) == F.col(f"b_{c}"))
    return a.join(b, met, "left_anti").drop("cell_x", "cell_y")


def far_from(left: DataFrame, right: DataFrame, reach: float, near: Column | None = None) -> DataFrame:
    """Points x, y of left that have no point of right within reach in both directions.

    Only right is dealt to several cells: a row of left is in one, and so is dropped or kept
    once. near replaces the predicate; it may use left's x, y and right's r_x, r_y.
    """
    cell = lambda k: F.floor(F.col(k) / reach)
    a = left.withColumn("cell_x", cell("x")).withColumn("cell_y", cell("y"))
    around = lambda k: F.explode(F.sequence(cell(k) - 1, cell(k) + 1))
    b = right.select(F.col("x").alias("r_x"), F.col("y").alias("r_y"), around("x").alias("r_cell_x"), F.col("y")).select("r_x", "r_y", "r_cell_x", around("y").alias("r_cell_y"))
    near = near if near is not None else (F.abs(F.col("x") - F.col("r_x")) <= reach) & (F.abs(F.col("y") - F.col("r_y")) <= reach)
    return a.join(b, (F.col("cell_x") == F.col("r_cell_x")) & (F.col("cell_y") == F.col("r_cell_y")) & near, "left_anti").drop("cell_x", "cell_y")


#: Boxes of a group from which it is swept by itself, cells of small grids held together, and boxes of an open group that are held.
MANY, MOST_CELLS, MOST_HELD = 12, 1 << 20, 1 << 16


def covered(boxes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Area that each group's boxes cover together; starts are where groups start, and the end. Groups of as many boxes lie on the grids of their own sides together."""
    size, out = np.diff(starts), np.zeros(len(starts) - 1)
    for k in np.unique(size[size > 0]).tolist():
        every = np.flatnonzero(size == k)
        if k > MANY:
            for i in every.tolist():
                out[i] = _swept(boxes[starts[i] : starts[i + 1]])
            continue
        for some in np.array_split(every, len(every) * (2 * k) ** 2 // MOST_CELLS + 1):
            own, sides = boxes[starts[some][:, None] + np.arange(k)], []
            for axis in (0, 1):
                at = np.sort(own[:, :, [axis, axis + 2]].reshape(len(some), -1), axis=1)
                sides.append((np.diff(at), (at[:, None, :-1] >= own[:, :, axis, None]) & (at[:, None, 1:] <= own[:, :, axis + 2, None])))
            (dx, in_x), (dy, in_y) = sides
            held = np.zeros((len(some), 2 * k - 1, 2 * k - 1), bool)
            for b in range(k):
                held |= in_x[:, b, :, None] & in_y[:, b, None, :]
            out[some] = (dx[:, :, None] * dy[:, None, :] * held).sum(axis=(1, 2))
    return out


def _swept(boxes: np.ndarray) -> float:
    """Area that boxes cover together: in each slab between neighbouring x edges the y intervals are merged with a running maximum."""
    boxes = np.unique(boxes, axis=0)
    boxes = boxes[np.argsort(boxes[:, 1], kind="stable")]
    edges, total = np.unique(boxes[:, [0, 2]]), 0.0
    for at, to in zip(edges[:-1], edges[1:], strict=True):
        own = boxes[(boxes[:, 0] <= at) & (boxes[:, 2] >= to)]
        if len(own):
            seen = np.concatenate((own[:1, 1], np.maximum.accumulate(own[:-1, 3])))
            total += float(np.maximum(0, own[:, 3] - np.maximum(own[:, 1], seen)).sum() * (to - at))
    return total


def _group_areas(cut: DataFrame, by: list[str], keys: tuple[str, ...]) -> DataFrame:
    """(keys, part) of each group by by, whose boxes lie together in order of x1. Of a group that doesn't end, what lies left of the last box is added up and let go."""
    schema = ", ".join(f"`{k}` {cut.schema[k].dataType.simpleString()}" for k in keys) + ", part double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_key, done = np.zeros((0, 4)), None, 0.0

        def row(key: pa.RecordBatch, areas: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(key.column(k) for k in keys), pa.array(areas)], names=[*keys, "part"])

        for batch in (b for b in batches if b.num_rows):
            boxes = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in BOX])
            new = np.zeros(batch.num_rows, bool)
            for k in by:
                column = batch.column(k)
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
            new[0] = open_key is None or any(open_key.column(k)[0] != batch.column(k)[0] for k in by)
            if open_key is not None and new[0]:
                yield row(open_key, np.array([done + covered(held, np.array([0, len(held)]))[0]]))
                held, done = held[:0], 0.0
            starts = np.flatnonzero(new)
            if len(starts) and starts[0] > 0 or not len(starts):  # the open group goes on
                stop = int(starts[0]) if len(starts) else len(boxes)
                held = np.concatenate((held, boxes[:stop]))
                if len(starts):
                    yield row(open_key, np.array([done + covered(held, np.array([0, len(held)]))[0]]))
                    held, done = held[:0], 0.0
            if len(starts):
                if len(starts) > 1:
                    yield row(batch.take(pa.array(starts[:-1])), covered(boxes, starts))
                open_key, held = batch.slice(int(starts[-1]), 1), boxes[starts[-1] :]
            if len(held) > MOST_HELD:
                line = held[-1, 0]
                gone = held[held[:, 0] < line]
                gone[:, 2] = np.minimum(gone[:, 2], line)
                done += covered(gone, np.array([0, len(gone)]))[0]
                held = held[held[:, 2] > line]
                held[:, 0] = np.maximum(held[:, 0], line)
                held = np.unique(held, axis=0)
        if open_key is not None:
            yield row(open_key, np.array([done + covered(held, np.array([0, len(held)]))[0]]))

    return cut.repartition(*by).sortWithinPartitions(*by, "x1").select(*by, *BOX).mapInArrow(run, schema)


def union_area(boxes: DataFrame, *keys: str, size: float | None = None, once: bool = False) -> DataFrame:
    """(keys, union_area) of the boxes of each key; boxes with a null corner, and null keys, count for nothing.

    With size, boxes are first cut along a grid of that step and dealt once to their cells; many cells are
    swept together in numpy, and only their sums are shuffled after it, so that the work
    grows with the boxes that share a cell and not with the square of those of a key. Without, it is a sweep over
    vertical slabs by joins and windows: a slab lies between neighbouring x edges; in it the y intervals are
    merged with a running maximum. There, with once, boxes are dealt once, so that edges, slabs and boxes lie together.
    """
    own, by = boxes.na.drop(subset=[*keys, *BOX]).filter("x2 > x1 and y2 > y1").select(*keys, *(F.col(c).cast("double") for c in BOX)), list(keys)
    if size:
        by = [*keys, "cell_x", "cell_y"]
        cut = [f(k, (F.col(f"cell_{k[0]}") + n) * size).alias(k) for k, f, n in (("x1", F.greatest, 0), ("y1", F.greatest, 0), ("x2", F.least, 1), ("y2", F.least, 1))]
        own = _cells(own, size).select(*by, *cut).filter("x2 > x1 and y2 > y1")
        return _group_areas(own, by, keys).groupBy(*keys).agg(F.sum("part").alias("union_area"))
    own = own.repartition(*by) if once else own
    edges = own.select(*by, F.explode(F.array("x1", "x2")).alias("from")).distinct()
    slabs = edges.withColumn("to", F.lead("from").over(Window.partitionBy(*by).orderBy("from"))).filter("to is not null")
    inside = slabs.join(own, by).filter((F.col("x1") <= F.col("from")) & (F.col("x2") >= F.col("to")))
    order = Window.partitionBy(*by, "from").orderBy("y1", "y2").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0.0), F.col("y2") - F.greatest(F.col("y1"), F.coalesce(F.max("y2").over(order), F.col("y1"))))
    return inside.withColumn("part", fresh * (F.col("to") - F.col("from"))).groupBy(*keys).agg(F.sum("part").alias("union_area"))


def common_part(pairs: DataFrame, *keep: str) -> DataFrame:
    """keep and the box that both sides of an overlap_join share."""
    return pairs.select(*keep, *(f(f"a_{c}", f"b_{c}").alias(c) for c, f in (("x1", F.greatest), ("y1", F.greatest), ("x2", F.least), ("y2", F.least))))
