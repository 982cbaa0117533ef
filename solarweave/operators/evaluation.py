"""Confusion counts, scores, summaries of images and promotion gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solarweave.operators.spatial import BOX, common_part, overlap_join, union_area

#: Thresholds of the sweep, limits of the gates.
THRESHOLDS = (0.15, 0.25, 0.35)
AREA_SLACK, OVERLAP_SHARE, PANEL_SLACK, LARGE_MASK, TOLERANCE = 1.0, 0.35, 5, 0.005, 0.0001


def confusion(df: DataFrame, truth: Column, predicted: Column, *by: str) -> DataFrame:
    """Counts tp, fp, fn for each group; null truth or prediction counts as negative."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    return df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))


def with_scores(counts: DataFrame) -> DataFrame:
    """iou, dice, precision, recall from tp, fp, fn; null where the denominator is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"iou": F.try_divide(tp, tp + fp + fn), "dice": F.try_divide(2 * tp, 2 * tp + fp + fn), "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn)})


def swept(df: DataFrame, truth: Column, score: Column, *by: str, thresholds=THRESHOLDS) -> DataFrame:
    """Confusion and scores at each threshold. Each row is counted once for all thresholds."""
    t = F.coalesce(truth, F.lit(False))
    sums = []
    for i, at in enumerate(thresholds):
        p = F.coalesce(score >= at, F.lit(False))
        sums += [F.count_if(t & p).alias(f"tp{i}"), F.count_if(~t & p).alias(f"fp{i}"), F.count_if(t & ~p).alias(f"fn{i}")]
    rows = F.array(*(F.struct(F.lit(at).alias("threshold"), *(F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "fn"))) for i, at in enumerate(thresholds)))
    return with_scores(df.groupBy(*by).agg(*sums).select(*by, F.inline(rows)))


def image_summary(masks: DataFrame, image_area: float, size: float | None = None) -> DataFrame:
    """Per image and label but roof: masks, area of their union, largest one, shares of the image, best confidence, sources.

    masks are (image, label, confidence, sources, box); sources is an array, and the result's
    is the sorted set of all. What masks cover twice counts once in total_area.
    """
    own = masks.filter("label <> 'roof'").withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    sets = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_sort(F.array_distinct(F.array_compact("sources")))))))
    each = own.groupBy("image", "label").agg(F.count("*").alias("mask_count"), F.max("area").alias("largest_area"), F.max("confidence").alias("max_confidence"), sets.alias("sources"))
    out = each.filter("image is not null and label is not null").join(union_area(own, "image", "label", size=size).withColumnRenamed("union_area", "total_area"), ["image", "label"], "left")
    out = out.withColumn("total_area", F.coalesce("total_area", F.lit(0.0)))
    return out.withColumn("total_fraction", F.col("total_area") / image_area).withColumn("largest_fraction", F.col("largest_area") / image_area)


def swiss_against_rid(masks: DataFrame, image_area: float, size: float) -> DataFrame:
    """Per image: area where swiss panels and rid obstacles overlap, its share of the image and of the panels (0 without any)."""
    pv = masks.filter((F.col("label") == "pv_installation") & F.array_contains("sources", "swiss")).select("image", *BOX)
    rid = masks.filter(~F.col("label").isin("pv_installation", "roof") & F.array_contains("sources", "rid")).select("image", *BOX)
    both = common_part(overlap_join(pv, rid, size, on=("image",)), F.col("a_image").alias("image"))
    out = masks.select("image").distinct().join(union_area(pv, "image", size=size).withColumnRenamed("union_area", "pv"), "image", "left").join(union_area(both, "image", size=size), "image", "left").na.fill(0.0, ["pv", "union_area"])
    relative = F.when(F.col("pv") > 0, F.col("union_area") / F.col("pv")).otherwise(0.0)
    return out.select("image", F.round("union_area", 6).alias("overlap"), F.round(F.col("union_area") / image_area, 6).alias("fraction"), F.round(relative, 6).alias("relative"))


def largest_rid_fraction(summaries: DataFrame) -> DataFrame:
    """(image, largest): the largest mask's share among labels of obstacles that rid saw; 0 where there is none."""
    seen = ~F.col("label").isin("pv_installation", "roof") & F.array_contains("sources", "rid")
    return summaries.groupBy("image").agg(F.coalesce(F.max(F.when(seen, F.col("largest_fraction"))), F.lit(0.0)).alias("largest"))


def site_areas(detections: DataFrame, size: float) -> DataFrame:
    """Per site: areas of the unions of panels, of what blocks besides, of what only advises, and panels' overlap with what blocks.

    detections are (site, kind, blocks, box); share is the overlap's part of the panels' area, 0 without panels.
    """
    pv, hard, soft = detections.filter("kind = 'pv_installation'"), detections.filter("kind <> 'pv_installation' and blocks"), detections.filter("not blocks")
    both = common_part(overlap_join(pv.select("site", *BOX), hard.select("site", *BOX), size, on=("site",)), F.col("a_site").alias("site"))
    out = detections.select("site").distinct()
    for name, part in (("pv", pv), ("hard", hard), ("advisory", soft), ("overlap", both)):
        out = out.join(union_area(part, "site", size=size).withColumnRenamed("union_area", name), "site", "left")
    return out.na.fill(0.0).withColumn("share", F.when(F.col("pv") > 0, F.round(F.col("overlap") / F.col("pv"), 4)).otherwise(0.0))


def compared(candidate: DataFrame, production: DataFrame) -> DataFrame:
    """Both sides' largest_fraction and mask_count by image and label; a missing side counts as 0."""
    side = lambda df, p: df.select("image", "label", F.col("largest_fraction").alias(f"{p}_largest"), F.col("mask_count").alias(f"{p}_count"))
    both = side(candidate, "candidate").join(side(production, "production"), ["image", "label"], "full_outer")
    return both.na.fill(0, [f"{p}_{c}" for p in ("candidate", "production") for c in ("largest", "count")])


def gates(pairs: DataFrame) -> DataFrame:
    """Per label: passed if no image's large mask grew by more than the tolerance, and the violations."""
    grew = (F.col("candidate_largest") > LARGE_MASK) & (F.col("candidate_largest") > F.col("production_largest") + TOLERANCE)
    return pairs.groupBy("label").agg(F.bool_and(~grew).alias("passed"), F.count_if(grew).alias("violations"), F.max(F.col("candidate_largest") - F.col("production_largest")).alias("worst"))


def regression_checks(pv_area: Column, base_area: Column, overlap: Column, base_overlap: Column, panels: Column, base_panels: Column) -> Column:
    """Struct of a site's checks against its baseline, and passed."""
    a, o, p = F.abs(pv_area - base_area) <= AREA_SLACK, overlap <= OVERLAP_SHARE * base_overlap, F.abs(panels - base_panels) <= PANEL_SLACK
    return F.struct(a.alias("pv_area"), o.alias("overlap"), p.alias("panels"), (a & o & p).alias("passed"))
