"""Roof records: parts of one house, building ledgers, and choice of the selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solarweave.functions.boxes import gap_squared
from solarweave.operators.components import connected_components
from solarweave.operators.spatial import BOX, overlap_join

#: Metres between parts of one house, and the greatest extent of a house.
NEAR, GREATEST = 1.5, 168.0
#: Houses of more parts grow one by one.
MOST_TOGETHER = 200


def touching_parts(parts: DataFrame, reach: float = NEAR, size: float = 16.0) -> DataFrame:
    """Parts (id, egid, box) with house: the least id that steps of at most reach connect within one egid.

    An egid that is null or not positive is unknown: such parts stand alone. No limit of
    extent. Parts meet through the grid cells that they touch when widened by half of reach.
    """
    known = parts.filter("egid > 0").select("id", "egid", "x1", "y1", "x2", "y2")
    wide = known.select("id", "egid", *((F.col(c) - reach).alias(c) if c[1] == "1" else (F.col(c) + reach).alias(c) for c in BOX), *(F.col(c).alias(f"own_{c}") for c in BOX))
    met = overlap_join(wide, wide, size, on=("egid",)).filter((F.col("a_id") < F.col("b_id")) & (gap_squared("a_own_", "b_own_") <= reach * reach))
    labels = connected_components(met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    return parts.join(labels, F.col("id") == F.col("node"), "left").withColumn("house", F.coalesce("component", "id")).drop("node", "component")


def grown_selection(parts: DataFrame, reach: float = NEAR, greatest: float = GREATEST) -> DataFrame:
    """(egid, id): parts that grow from the selected ones of each egid, in the order of their ids.

    parts are (id, egid, box) and may have selected; without it, or where none is selected, an
    egid's first part is. Where the egid is null or not positive the selected parts stay as they
    are and nothing joins them. A part joins if it is within reach of what has grown so far and keeps
    the extent within greatest; passes repeat until none joins. The result depends on the
    order, so an egid is one row; it is a house and small. Houses of as many parts grow together.
    """

    def grow(box: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        chosen = chosen if chosen.any() else np.arange(len(chosen)) == 0
        bounds = np.r_[box[chosen, :2].min(axis=0), box[chosen, 2:].max(axis=0)]
        size_before = -1
        while size_before < chosen.sum():
            size_before = chosen.sum()
            for i in np.flatnonzero(~chosen):
                apart = np.maximum(0, np.maximum(box[chosen, :2] - box[i, 2:], box[i, :2] - box[chosen, 2:]))
                wider = np.r_[np.minimum(bounds[:2], box[i, :2]), np.maximum(bounds[2:], box[i, 2:])]
                if (wider[2:] - wider[:2]).max() <= greatest and np.hypot(*apart.T).min() <= reach:
                    chosen[i], bounds = True, wider
        return chosen

    def grow_all(box: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Houses of n parts each, (houses, n, 4) and (houses, n): each step looks at one part of every house."""
        chosen = chosen.copy()
        chosen[:, 0] |= ~chosen.any(axis=1)
        low = np.where(chosen[..., None], box[..., :2], np.inf).min(axis=1)
        high = np.where(chosen[..., None], box[..., 2:], -np.inf).max(axis=1)
        active = np.arange(len(box))
        while len(active):
            b, c, before = box[active], chosen[active], chosen[active].sum(axis=1)
            for i in range(b.shape[1]):
                apart = np.maximum(0, np.maximum(b[:, :, :2] - b[:, i : i + 1, 2:], b[:, i : i + 1, :2] - b[:, :, 2:]))
                near = np.where(c, np.hypot(apart[..., 0], apart[..., 1]), np.inf).min(axis=1) <= reach
                down, up = np.minimum(low[active], b[:, i, :2]), np.maximum(high[active], b[:, i, 2:])
                takes = ~c[:, i] & near & ((up - down).max(axis=1) <= greatest)
                c[takes, i] = True
                low[active[takes]], high[active[takes]] = down[takes], up[takes]
            chosen[active] = c
            active = active[c.sum(axis=1) > before]
        return chosen

    def run(batches):
        for batch in batches:
            egid, count = batch.column("egid").to_numpy(), pc.list_value_length(batch.column("parts")).to_numpy()
            parts = batch.column("parts").flatten()
            box, ids = np.column_stack([parts.field(c).to_numpy(zero_copy_only=False) for c in BOX]).astype(float), parts.field("id").to_numpy(zero_copy_only=False)
            chosen = parts.field("selected").to_numpy(zero_copy_only=False).astype(bool)
            first = np.cumsum(count) - count
            for n in np.unique(count).tolist():
                some = np.flatnonzero(count == n)
                for own in np.array_split(some, len(some) * n * n // 500_000 + 1):
                    at = first[own][:, None] + np.arange(n)
                    chosen[at] = grow_all(box[at], chosen[at]) if n <= MOST_TOGETHER else np.stack([grow(box[k], chosen[k]) for k in at])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(egid, count)[chosen]), pa.array(ids[chosen])], names=["egid", "id"])

    own = parts.select(F.col("id").cast("long").alias("id"), F.col("egid").cast("long").alias("egid"), *BOX, F.col("selected") if "selected" in parts.columns else F.lit(False).alias("selected"))
    houses = own.filter("egid > 0").groupBy("egid").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("selected", F.lit(False)).alias("selected"), *BOX))).alias("parts"))
    grown = houses.mapInArrow(run, "egid long, id long")
    return grown.unionByName(own.filter("selected and not coalesce(egid > 0, false)").select("egid", "id"))


def neighbours(requests: DataFrame, parts: DataFrame, margin: float = 70.0, size: float = 80.0) -> DataFrame:
    """(request, id) of the parts around each request's selection: those whose box meets its box widened by margin.

    requests are (request, id, egid, box). A selection without a known egid isn't widened and
    keeps its own part alone; a selection whose surroundings hold nothing keeps it as well.
    """
    known = requests.filter("egid > 0").select("request", *((F.col(c) - margin).alias(c) if c[1] == "1" else (F.col(c) + margin).alias(c) for c in BOX))
    met = overlap_join(known, parts.select("id", *BOX), size).select(F.col("a_request").alias("request"), F.col("b_id").alias("id"))
    return met.union(requests.select("request", "id")).distinct()


def selection(by_point: DataFrame, by_key: DataFrame) -> DataFrame:
    """Records (request, id, rings) by key where that search found some and all of them have rings; else those by point."""
    good = by_key.groupBy("request").agg(F.bool_and(F.size("rings") > 0).alias("whole")).filter("whole").select("request")
    return by_key.join(good, "request", "left_semi").unionByName(by_point.join(good, "request", "left_anti"))


def planning_area(face: Column, detected: Column, model_ready: Column) -> Column:
    """Area to plan on: none where the roof model is ready but found no roof; all where it isn't ready."""
    return F.when(~model_ready, face).otherwise(F.coalesce(detected, F.lit(0.0)))


def alignment_reason(best: Column, base: Column, rival: Column, shift: Column, support: Column, limit: float = 4.0) -> Column:
    """Why a shift of a roof to the image is or isn't applied; the first failed test counts."""
    return (
        F.when((best < 30) | (best < base * 1.5) | (best - base < 12), "no_clear_improvement")
        .when(rival.isNotNull() & (best < rival * 1.12), "ambiguous_boundary")
        .when(shift > limit - 0.25, "search_limit")
        .when(support < 3, "insufficient_directional_support")
        .otherwise("image_boundary_match")
    )
