"""Detections: validation, provenance, merging and arbitration between sources."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solarweave.functions.boxes import overlap, ring_area
from solarweave.operators.spatial import BOX, common_part, overlap_join, union_area

#: Other names of kinds, the kinds, those that don't block, priority of sources, thresholds.
ALIASES = {"existing_pv": "pv_installation", "solar_panel": "pv_installation", "solar_panels": "pv_installation", "pv": "pv_installation", "unknown_obstacle": "other_obstacle", "window": "skylight"}
KINDS = ("pv_installation", "roof", "chimney", "skylight", "dormer", "other_obstacle", "ladder", "tree", "shadow")
NOT_BLOCKING = ("shadow",)
PRIORITY = {"survey": 50, "height": 40, "rooflight": 30, "swiss": 20, "rid": 10}
SAME_SHARE, TRUSTED, TINY, SURVEY_LEAST = 0.5, 0.5, 1e-8, 0.15



def priority(source: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair]), source), F.lit(0))


def kind_of(name: Column) -> Column:
    """The kind that a name means; null for a name outside the vocabulary."""
    full = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), name), name)
    return F.when(full.isin(*KINDS), full)


def valid_confidence(c: Column) -> Column:
    """Null (measured evidence), or a number from 0 to 1; NaN is not one."""
    return c.isNull() | (~F.isnan(c) & c.between(0, 1))


def normalised(detections: DataFrame, strict: bool = False) -> DataFrame:
    """Detections with kind, label, model and source filled in; those that are invalid are left
    out, or raise an error if strict. Boxes under 1e-8 square metres are left out."""
    out = detections.withColumn("kind", kind_of(F.col("name"))).withColumn("source", F.coalesce("source", F.lit("unknown")))
    fine = F.col("kind").isNotNull() & valid_confidence(F.col("confidence"))
    if strict:
        out = out.withColumn("kind", F.when(fine, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("invalid detection: "), F.coalesce("name", F.lit("null"))))))
    else:
        out = out.filter(fine)
    return out.withColumn("label", F.col("kind")).withColumn("model", F.coalesce("model", "source", F.lit("unknown"))).filter((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) > TINY)


def blocks_placement(kind: Column) -> Column:
    return ~kind.isin(*NOT_BLOCKING)


def merged_by_key(detections: DataFrame, *keys: str) -> DataFrame:
    """Detections known to be one thing (equal keys): highest confidence, sorted sources, and the
    representative of highest priority, then confidence, then earliest seq."""
    rank = F.struct(priority(F.col("source")).alias("p"), F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("seq")).alias("s"))
    best = F.max_by("source", rank).alias("source")
    return detections.groupBy(*keys).agg(best, F.max("confidence").alias("confidence"), F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources"), F.count("*").alias("members"))


def same_kind_pairs(detections: DataFrame, size: float) -> DataFrame:
    """(a_id, b_id, overlap) of detections of one kind that share more than half of the smaller area."""
    keep = detections.select("id", "kind", *BOX)
    pairs = overlap_join(keep, keep, size, on=("kind",)).filter("a_id < b_id")
    area = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))
    return pairs.filter(F.col("overlap") > SAME_SHARE * F.least(area("a_"), area("b_"))).select("a_id", "b_id", "overlap")


def source_set(sources: Column, source: Column, model: Column) -> Column:
    """Sorted set of a detection's sources: its own list, else its source, else its model, else unknown."""
    one = F.array(F.coalesce(source, model, F.lit("unknown")))
    return F.array_sort(F.array_distinct(F.coalesce(sources, one)))


def arbitrated(detections: DataFrame, size: float) -> DataFrame:
    """Detections with clipped_area: obstacles that rid alone saw lose what trusted panels cover.

    Trusted are panels with swiss among their sources and a confidence of 0.5 or more; an
    obstacle whose set of sources holds more than rid is measured evidence and stays whole.
    Columns id, kind, sources (a set), confidence and a box are needed. The share that panels
    cover is the area of the union of the parts that they cover, so panels that overlap each
    other count once.
    """
    trusted = detections.filter((F.col("kind") == "pv_installation") & F.array_contains("sources", "swiss") & (F.col("confidence") >= TRUSTED))
    subject = ~F.col("kind").isin("pv_installation", "roof", "shadow") & (F.array_distinct("sources") == F.array(F.lit("rid")))
    met = overlap_join(detections.filter(subject).select("id", *BOX), trusted.select("id", *BOX), size)
    lost = union_area(common_part(met, F.col("a_id").alias("id")), "id", size=size)
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    out = detections.join(lost, "id", "left").withColumn("clipped_area", area - F.coalesce("union_area", F.lit(0.0))).drop("union_area")
    return out.filter(F.col("clipped_area") > TINY).withColumn("blocks_placement", blocks_placement(F.col("kind")))


def all_sources(*detections: DataFrame) -> DataFrame:
    """Detections of several sources as one table; columns that a source lacks are null there."""
    out = detections[0]
    for more in detections[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def survey_parts(parts: DataFrame, roofs: DataFrame, size: float, least: float = SURVEY_LEAST) -> DataFrame:
    """Survey parts (id, box) clipped to roofs (roof, box): id, roof and box of each piece of at least 0.15 square metres."""
    met = overlap_join(parts.select("id", *BOX), roofs.select("roof", *BOX), size)
    cut = common_part(met, F.col("a_id").alias("id"), F.col("b_roof").alias("roof"))
    return cut.withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).filter(F.col("area") >= least)


def polygon_parts(detections: DataFrame) -> DataFrame:
    """One row for each part of a detection's polygons (array of rings of x, y) that covers more than 1e-8 square metres.

    A ring of fewer than three points covers nothing; part counts from 0 among all parts.
    """
    out = detections.select("*", F.posexplode("polygons").alias("part", "ring")).drop("polygons")
    return out.withColumn("area", ring_area(F.col("ring"))).filter(F.col("area") > TINY)


def _covered(boxes: np.ndarray) -> float:
    """Area of the union of a few boxes (rows x1, y1, x2, y2), on the grid of their own edges."""
    if len(boxes) == 1:
        return float((boxes[0, 2] - boxes[0, 0]) * (boxes[0, 3] - boxes[0, 1]))
    xs, ys = np.unique(boxes[:, [0, 2]]), np.unique(boxes[:, [1, 3]])
    full = np.zeros((len(xs) - 1, len(ys) - 1), bool)
    for x1, y1, x2, y2 in boxes:
        full[np.searchsorted(xs, x1) : np.searchsorted(xs, x2), np.searchsorted(ys, y1) : np.searchsorted(ys, y2)] = True
    return float((np.outer(np.diff(xs), np.diff(ys)) * full).sum())


def _fold(boxes: np.ndarray) -> list[tuple[list[int], float]]:
    """Greedy merge of one kind in one analysis, in the order given: members and area of each group.

    A group is a set of boxes with bounds; a new box is held only against groups whose bounds
    it meets, and their shared area is that of the union of the members' parts inside it.
    Groups that share more than half of the smaller area with it become one. What was merged
    is not tested again. Memory is the boxes' own.
    """
    members: list[list[int] | None] = []
    bounds, areas = np.zeros((len(boxes), 4)), np.zeros(len(boxes))
    for i, box in enumerate(boxes):
        n, area = len(members), float((box[2] - box[0]) * (box[3] - box[1]))
        own, hits = bounds[:n], []
        near = np.flatnonzero((own[:, 0] < box[2]) & (own[:, 2] > box[0]) & (own[:, 1] < box[3]) & (own[:, 3] > box[1]))
        for g in near.tolist():
            part = boxes[members[g]]
            part = np.column_stack((np.maximum(part[:, :2], box[:2]), np.minimum(part[:, 2:], box[2:])))
            part = part[(part[:, 2] > part[:, 0]) & (part[:, 3] > part[:, 1])]
            if len(part) and _covered(part) > SAME_SHARE * min(area, areas[g]):
                hits.append(g)
        whole = [i, *(j for g in hits for j in members[g])]
        for g in hits:
            members[g], bounds[g] = None, (np.inf, np.inf, -np.inf, -np.inf)
        members.append(whole)
        bounds[n] = (*boxes[whole, :2].min(axis=0), *boxes[whole, 2:].max(axis=0))
        areas[n] = _covered(boxes[whole])
    return [(m, float(areas[g])) for g, m in enumerate(members) if m is not None]


#: Groups of at most so many boxes are folded together, this many cells of their grids at once.
FEW, MOST_CELLS = 8, 1 << 19


def _folds(boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _fold, of many groups of equal size (groups, size, 4): the place of each box's merged group, its turn there, and the areas by place.

    Boxes are cells of the grid of their group's sides; a merged group's place is that of the
    box that made it, the turn is the order in which _fold names its members.
    """
    n, m, _ = boxes.shape
    cover, step = [], []
    for axis in (0, 1):
        at = np.sort(boxes[:, :, [axis, axis + 2]].reshape(n, -1), axis=1)
        cover.append((at[:, None, :-1] >= boxes[:, :, axis, None]) & (at[:, None, 1:] <= boxes[:, :, axis + 2, None]))
        step.append(np.diff(at))
    cells = (step[0][:, :, None] * step[1][:, None, :]).reshape(n, -1)
    own = (cover[0][:, :, :, None] & cover[1][:, :, None, :]).reshape(n, m, -1)
    area = (boxes[:, :, 2] - boxes[:, :, 0]) * (boxes[:, :, 3] - boxes[:, :, 1])
    place, turn, merged, areas = np.tile(np.arange(m), (n, 1)), np.zeros((n, m), np.int64), own.copy(), area.copy()
    live = np.ones((n, m), bool)
    for i in range(1, m):
        shared = ((merged[:, :i] & own[:, i, None]) * cells[:, None]).sum(axis=2)
        hit = live[:, :i] & (shared > 0) & (shared > SAME_SHARE * np.minimum(area[:, i, None], areas[:, :i]))
        g = np.flatnonzero(hit.any(axis=1))
        if len(g):
            hit = hit[g]
            size = (place[g][:, None, :i] == np.arange(i)[:, None]).sum(axis=2) * hit
            before = np.cumsum(size, axis=1) - size + 1
            at = place[g][:, :i]
            moves = np.take_along_axis(hit, at, axis=1)
            turn[g, :i] = np.where(moves, turn[g, :i] + np.take_along_axis(before, at, axis=1), turn[g, :i])
            place[g, :i] = np.where(moves, i, at)
            live[g, :i] &= ~hit
            merged[g, i] |= (merged[g, :i] & hit[:, :, None]).any(axis=1)
            areas[g, i] = (merged[g, i] * cells[g]).sum(axis=1)
    return place, turn, areas


def _merged(boxes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, turn, area) of each box: groups that lie one after the other, in the order of their fold, each from its start. group is a box of the merged group."""
    size = np.diff(np.r_[starts, len(boxes)])
    group, turn, area = np.arange(len(boxes)), np.zeros(len(boxes), np.int64), np.zeros(len(boxes))
    for m in np.unique(size).tolist():
        every = starts[size == m]
        if m > FEW:
            for at in every.tolist():
                for members, whole in _fold(boxes[at : at + m]):
                    own = at + np.array(members)
                    group[own], turn[own], area[own] = own.max(), np.arange(len(own)), whole
            continue
        for some in np.array_split(every, max(1, -(-len(every) * m * (2 * m - 1) ** 2 // MOST_CELLS))):
            at = some[:, None] + np.arange(m)
            place, turn[at], areas = _folds(boxes[at])
            group[at], area[at] = some[:, None] + place, np.take_along_axis(areas, place, axis=1)
    return group, turn, area


def greedy_merge(detections: DataFrame, per_bucket: int = 20_000) -> DataFrame:
    """Merged detections of each analysis and kind: sequential within, parallel across.

    Items come by falling confidence (null as 0), then seq. The representative has the highest
    priority, then confidence; of equals the latest in the fold. Disjoint parts of one merged
    group count as one row here. One analysis must fit one task, as it does one building;
    many analyses share a bucket, so that small ones cost no task of their own, and small
    groups of a bucket are folded together.
    """
    buckets = max(1, detections.count() // per_bucket)
    schema = "analysis long, kind string, first_id long, members long, area double, source string, sources string, confidence double"

    def fold(table: pa.Table) -> pa.Table:
        numbers = lambda c, t: table.column(c).cast(t).to_numpy()
        known = pc.is_valid(table.column("confidence")).to_numpy()
        confidence = np.where(known, pc.fill_null(table.column("confidence").cast(pa.float64()), 0.0).to_numpy(), np.nan)
        score = np.nan_to_num(confidence, nan=0.0)
        kinds, names = (table.column(c).combine_chunks().dictionary_encode() for c in ("kind", "source"))
        # codes in the order of their text, null last
        ranks = lambda d: np.r_[np.argsort(np.argsort(d.dictionary.to_numpy(zero_copy_only=False))), len(d.dictionary)][pc.fill_null(d.indices, len(d.dictionary)).to_numpy()]
        kind, source = ranks(kinds), ranks(names)
        texts = sorted(names.dictionary.to_pylist())
        analysis = numbers("analysis", pa.int64())
        order = np.lexsort((numbers("seq", pa.float64() if table.schema.field("seq").type == pa.float64() else pa.int64()), -score, kind, analysis))
        new = np.flatnonzero((np.diff(analysis[order]) != 0) | (np.diff(kind[order]) != 0)) + 1
        boxes = np.column_stack([numbers(c, pa.float64()) for c in BOX])[order]
        group, turn, area = _merged(boxes, np.r_[0, new])
        source, confidence, score, ids = source[order], confidence[order], score[order], numbers("id", pa.int64())[order]
        ranked = np.array([PRIORITY.get(t, 0) for t in texts] + [0])[source]
        own = np.lexsort((turn, -score, -ranked, group))
        first = np.flatnonzero(np.r_[True, np.diff(group[own]) != 0])
        best, members = own[first], np.diff(np.r_[first, len(own)])
        top = np.fmax.reduceat(confidence[own], first)
        pairs = np.unique(np.column_stack((np.repeat(np.arange(len(first)), members), source[own])), axis=0)
        start = np.searchsorted(pairs[:, 0], np.arange(len(first)))
        many, named = np.diff(np.r_[start, len(pairs)]), np.array([*texts, None], object)
        sources = named[pairs[start, 1]]
        for k in range(1, int(many.max(initial=1))):
            more = np.flatnonzero(many > k)
            sources[more] = sources[more] + "," + named[pairs[start[more] + k, 1]]
        rows = pa.array(order[best])
        columns = [table.column("analysis").take(rows).cast(pa.int64()), table.column("kind").take(rows), np.minimum.reduceat(ids[own], first), members, area[best], table.column("source").take(rows), pa.array(sources, pa.string()), pa.array(top, pa.float64(), mask=np.isnan(top))]
        return pa.table(columns, names=[c.split()[0] for c in schema.split(", ")])

    rows = detections.select("analysis", "kind", "id", "seq", "confidence", "source", *BOX)
    return rows.groupBy(F.pmod(F.xxhash64("analysis", "kind"), F.lit(buckets)).alias("bucket")).applyInArrow(fold, schema)


def summary(detections: DataFrame) -> DataFrame:
    """Count and area for each kind:source."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return detections.groupBy(F.concat_ws(":", "kind", "source").alias("kind_source")).agg(F.count("*").alias("n"), F.sum(area).alias("area"))


def overlap_share(a: str, b: str) -> Column:
    """Area shared by two boxes relative to the first; 0 where the first has none."""
    own = (F.col(f"{a}x2") - F.col(f"{a}x1")) * (F.col(f"{a}y2") - F.col(f"{a}y1"))
    return F.when(own > 0, overlap(a, b) / own).otherwise(F.lit(0.0))


def in_order(detections: DataFrame, *keys: str) -> DataFrame:
    """Detections with place: their turn in the merge."""
    order = Window.partitionBy(*keys).orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "seq")
    return detections.withColumn("place", F.row_number().over(order))
