"""Operators on small made-up inputs, against what they must give."""

import json
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from solarweave import storage
from solarweave.functions import boxes, overlay, overlays
from solarweave.operators import curation, evaluation, fusion, layout, packing, polygons, raster, registration, roofs, spatial, status, surfaces
from solarweave.operators.components import connected_components
from solarweave.sources import files, keys, pages
from solarweave.streaming import state


def box_rows(n, seed, span=20.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.randint(0, int(span * 4)) / 4, rng.randint(0, int(span * 4)) / 4
        out.append((i, i % 3, x, y, x + rng.randint(1, 12) / 4, y + rng.randint(1, 12) / 4))
    return out


def shared(a, b):
    return max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))


COLUMNS = "id long, k long, x1 double, y1 double, x2 double, y2 double"


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3), (5, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_hot_key_is_split(spark):
    """Half of the rows on one key: the join back has a skewed partition that is dealt to several tasks."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 100_000, 1, 8).select(F.col("id"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"))
        out = curation.first_of_each(rows, F.col("k"), "id")
        kept = [r.keep for r in out.collect()]
        assert (kept.count(True), len(kept)) == (50_001, 100_000)
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stored_results_are_cleared(spark):
    one, two = storage.Stored(spark.range(3), "x"), storage.Stored(spark.range(4), "x")
    one.drop()
    assert two.df.count() == 4 and not os.path.exists(one.path)
    before = two.path
    other = spark.newSession()
    assert storage.Stored(other.range(2), "y").path.startswith(os.path.dirname(before))
    two.drop()
    assert not os.path.exists(before)


def test_a_cluster_needs_a_shared_folder(spark):
    class Session:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        storage.shared_dir(Session())


def test_overlap_join_equals_all_pairs(spark):
    a, b = box_rows(80, 1), box_rows(90, 2)
    got = spatial.overlap_join(spark.createDataFrame(a, COLUMNS), spark.createDataFrame(b, COLUMNS), 2.0, on=("k",)).select("a_id", "b_id", "overlap").collect()
    assert sorted(map(tuple, got)) == sorted((x[0], y[0], shared(x, y)) for x in a for y in b if x[1] == y[1] and shared(x, y) > 0)


def test_far_from_equals_all_pairs(spark):
    rng = random.Random(4)
    a, b = ([(i, rng.uniform(0, 300), rng.uniform(0, 300)) for i in range(n)] for n in (120, 20))
    got = spatial.far_from(spark.createDataFrame(a, "id long, x double, y double"), spark.createDataFrame(b, "id long, x double, y double"), 25.0)
    assert {r.id for r in got.collect()} == {p[0] for p in a if all(max(abs(p[1] - q[1]), abs(p[2] - q[2])) > 25 for q in b)}


def test_union_area_counts_cells(spark):
    rows = box_rows(60, 5, 8.0) + [(99, 0, None, 1.0, 2.0, 2.0)]
    got = {r.k: r.union_area for r in spatial.union_area(spark.createDataFrame(rows, COLUMNS), "k").collect()}
    for k in range(3):
        cells = {(i, j) for r in rows if r[1] == k and r[2] is not None for i in range(int(r[2] * 4), int(r[4] * 4)) for j in range(int(r[3] * 4), int(r[5] * 4))}
        assert got[k] == pytest.approx(len(cells) / 16)


def test_best_layout_equals_loops(spark):
    rows = [(1, 12.0, 8.0, 20.0, 0.0), (2, 20.0, 12.0, 30.0, 90.0), (3, 0.5, 1.0, 10.0, 0.0), (4, 5.0, 4.0, 3.0, 180.0), (5, 1.2, 9.0, 45.0, 270.0)]
    import math

    for r in layout.best_layouts(spark.createDataFrame(rows, "face_id long, w double, h double, slope double, aspect double")).collect():
        u, v = (r.w, r.h) if r.aspect % 180 == 0 else (r.h, r.w)
        u, v, best = u - 1.2, v / math.cos(math.radians(r.slope)) - 1.2, 0
        for w, h, ox, oy in layout.LAYOUTS:
            sx, sy, n = w + 0.1, h + (1.0 if r.slope < 5 else 0.35), 0
            i = 0
            while ox * sx + i * sx + w <= u + 1e-8:
                x = ox * sx + i * sx
                i += 1
                if u > 12 and v > 6 and x + w > u / 2 - 0.4 and x < u / 2 + 0.4:
                    continue
                j = 0
                while oy * sy + j * sy + h <= v + 1e-8:
                    n, j = n + 1, j + 1
            best = max(best, n)
        assert r.panel_count == (best if r.w * r.h >= 1 and u > 0 and v > 0 else 0), r


def test_plane_is_undone(spark):
    df = spark.createDataFrame([(3.0, 4.0, 30.0, 140.0), (-2.0, 7.5, 0.0, 0.0)], "x double, y double, s double, a double")
    p = boxes.to_plane(F.col("x"), F.col("y"), F.col("s"), F.col("a"))
    for r in df.withColumn("p", p).withColumn("b", boxes.from_plane(F.col("p.u"), F.col("p.v"), F.col("s"), F.col("a"))).collect():
        assert r.b.x == pytest.approx(r.x, abs=1e-7) and r.b.y == pytest.approx(r.y, abs=1e-7)


def test_ring_with_few_points(spark):
    df = spark.createDataFrame([([],), ([(0.0, 0.0), (1.0, 1.0)],), ([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)],)], "ring array<struct<x double, y double>>")
    assert [r.a for r in df.select(boxes.ring_area(F.col("ring")).alias("a")).collect()] == [0.0, 0.0, 6.0]


def test_invalid_detections_go_or_raise(spark):
    rows = [(1, "car", 0.5), (2, "pv", float("nan")), (3, "pv", 2.0), (4, "window", None), (5, None, 0.1), (6, "existing_pv", 1.0)]
    df = spark.createDataFrame(rows, "id long, name string, confidence double").withColumns({"source": F.lit(None).cast("string"), "model": F.lit(None).cast("string"), "x1": F.lit(0.0), "y1": F.lit(0.0), "x2": F.lit(1.0), "y2": F.lit(1.0)})
    assert {(r.id, r.kind, r.model) for r in fusion.normalised(df).collect()} == {(4, "skylight", "unknown"), (6, "pv_installation", "unknown")}
    with pytest.raises(Exception, match="invalid detection"):
        fusion.normalised(df, strict=True).collect()


def test_merge_is_greedy_and_not_transitive(spark):
    rows = [(1, "pv", 1, 1, 0.9, "rid", 0.0, 0.0, 2.0, 1.0), (1, "pv", 2, 2, 0.8, "survey", 0.0, 0.0, 2.0, 1.0), (1, "pv", 3, 3, None, "rid", 1.5, 0.0, 3.5, 1.0), (1, "chimney", 4, 4, 0.5, "rid", 0.0, 0.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "analysis long, kind string, id long, seq long, confidence double, source string, x1 double, y1 double, x2 double, y2 double")
    got = {(r.kind, r.first_id): (r.members, r.area, r.source, r.sources, r.confidence) for r in fusion.greedy_merge(df).collect()}
    assert got == {("pv", 1): (2, 2.0, "survey", "rid,survey", 0.9), ("pv", 3): (1, 2.0, "rid", "rid", None), ("chimney", 4): (1, 2.0, "rid", "rid", 0.5)}


def test_merge_equals_counted_cells(spark):
    """Groups as sets of cells of half a metre: what the fold must give, on many boxes of one analysis."""
    rng, rows = random.Random(11), []
    for i in range(150):
        x, y = rng.randint(0, 60) / 2, rng.randint(0, 40) / 2
        rows.append((1, "chimney", i, i, rng.randint(0, 9) / 10, "rid", x, y, x + rng.randint(1, 8) / 2, y + rng.randint(1, 8) / 2))
    df = spark.createDataFrame(rows, "analysis long, kind string, id long, seq long, confidence double, source string, x1 double, y1 double, x2 double, y2 double")
    groups = []
    for r in sorted(rows, key=lambda r: (-r[4], r[3])):
        own = {(a, b) for a in range(int(2 * r[6]), int(2 * r[8])) for b in range(int(2 * r[7]), int(2 * r[9]))}
        hits = [g for g in groups if len(g[0] & own) > 0.5 * min(len(g[0]), len(own))]
        groups = [g for g in groups if g not in hits] + [(own.union(*(g[0] for g in hits)), {r[2]}.union(*(g[1] for g in hits)))]
    got = {(r.first_id, r.members, r.area) for r in fusion.greedy_merge(df).collect()}
    assert got == {(min(ids), len(ids), len(cells) / 4) for cells, ids in groups} and len(got) < 140


def test_splits_have_their_shares(spark):
    n = {r.s: r["count"] for r in spark.range(4000).groupBy(curation.split_of(F.col("id")).alias("s")).count().collect()}
    assert abs(n["train"] - 2800) < 120 and abs(n["val"] - 600) < 90 and abs(n["test"] - 600) < 90


def test_first_of_each_with_nulls(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, ""), (5, None)], "id long, t string")
    got = {r.id: (r.duplicate_of, r.keep) for r in curation.first_of_each(df, F.col("t"), "id").collect()}
    assert got == {1: (None, True), 3: (1, False), 2: (None, True), 4: (2, False), 5: (2, False)}


def test_scores_of_nothing_are_null(spark):
    df = spark.createDataFrame([(False, False), (None, False)], "t boolean, p boolean")
    r = evaluation.with_scores(evaluation.confusion(df, F.col("t"), F.col("p"))).first()
    assert (r.tp, r.fp, r.fn, r.iou, r.dice, r.precision, r.recall) == (0, 0, 0, None, None, None, None)


def test_planes_find_the_roof(spark):
    rows = [(1, r, c, 500 + 0.3 * c - 0.1 * r + (2.0 if 5 <= r < 8 and 5 <= c < 8 else 0.0)) for r in range(16) for c in range(16)]
    df = spark.createDataFrame(rows, "image long, r int, c int, z double")
    p = raster.consensus_planes(df).first()
    assert (p.a, p.b, p.z0) == pytest.approx((0.3, -0.1, 500), abs=1e-6) and p.inliers == 256 - 9
    flat = raster.plane_fits(df.filter("not (r between 5 and 7 and c between 5 and 7)")).first()
    assert (flat.a, flat.b, flat.z0) == pytest.approx((0.3, -0.1, 500), abs=1e-6)
    assert raster.consensus_planes(df.filter("r < 2 and c < 4")).count() == 0


def test_closing_fills_a_hole(spark):
    df = spark.createDataFrame([(1, r, c, 0 if (r, c) == (3, 3) else 1) for r in range(7) for c in range(7)], "image long, r int, c int, m int")
    assert raster.closed(df, F.col("m")).agg(F.min("v")).first()[0] == 1
    assert raster.eroded(df, F.col("m")).filter("v = 0").count() == 9


def test_parts_grow_within_the_extent(spark):
    rows = [(1, 9, 0.0, 0.0, 10.0, 10.0), (2, 9, 11.0, 0.0, 20.0, 10.0), (3, 9, 40.0, 0.0, 50.0, 10.0), (4, 9, 21.0, 0.0, 170.0, 10.0), (5, 0, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, egid long, x1 double, y1 double, x2 double, y2 double")
    assert {r.id for r in roofs.grown_selection(df).collect()} == {1, 2}
    assert {r.id: r.house for r in roofs.touching_parts(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def slow_pack(face, slope, obstacles, claimed):
    """Modules of one face by plain loops: the bounds from a fine scan of corners, then every layout and place."""
    out = lambda b, d: (b[0] - d, b[1] - d, b[2] + d, b[3] + d)
    shut = [out(c, 0.6) for c in claimed] + [out(o, 0.5) for o in obstacles]
    inner = out(face, -0.6)

    def bounds():
        xs = sorted({min(max(v, inner[0]), inner[2]) for b in [inner, *shut] for v in (b[0], b[2])})
        ys = sorted({min(max(v, inner[1]), inner[3]) for b in [inner, *shut] for v in (b[1], b[3])})
        open_ = [(x, y, x2, y2) for x, x2 in zip(xs, xs[1:], strict=False) for y, y2 in zip(ys, ys[1:], strict=False) if not any(b[0] <= (x + x2) / 2 <= b[2] and b[1] <= (y + y2) / 2 <= b[3] for b in shut)]
        return open_ and (min(o[0] for o in open_), min(o[1] for o in open_), max(o[2] for o in open_), max(o[3] for o in open_))

    left = bounds()
    if left and left[2] - left[0] > 12 and left[3] - left[1] > 6:
        shut.append(((left[0] + left[2]) / 2 - 0.4, -99, (left[0] + left[2]) / 2 + 0.4, 99))
        left = bounds()
    best = []
    for w, h in ((1.134, 1.762), (1.762, 1.134)) if left else ():
        for ox in (0, 0.25, 0.5, 0.75):
            for oy in (0, 0.25, 0.5, 0.75):
                own, sx, sy = [], w + 0.1, h + (1.0 if slope < 5 else 0.35)
                i = 0
                while (x := left[0] + (ox + i) * sx) + w <= left[2] + 1e-8:
                    j = 0
                    while (y := left[1] + (oy + j) * sy) + h <= left[3] + 1e-8:
                        if not any(x < b[2] - 1e-8 and x + w > b[0] + 1e-8 and y < b[3] - 1e-8 and y + h > b[1] + 1e-8 for b in shut):
                            own.append((x, y, x + w, y + h))
                        j += 1
                    i += 1
                best = own if len(own) > len(best) else best
    return best


def test_ledger_equals_loops(spark):
    """Overlapping faces, flat and steep, turned either way, with obstacles: earlier faces and their modules shut later ones out."""
    rng, faces, obstacles = random.Random(3), [], []
    for building in range(8):
        for k in range(3):
            x, y = rng.randint(0, 12), rng.randint(0, 8)
            faces.append((building, building * 10 + k, float(rng.choice((0, 3, 20, 45))), float(rng.choice((0, 90, 180, 270))), float(x), float(y), x + rng.choice((4.0, 9.0, 16.0)), y + rng.choice((5.0, 8.0))))
        obstacles += [(building, ox, oy, ox + 0.5, oy + 1.0) for ox, oy in ((rng.randint(0, 20) / 2, rng.randint(0, 16) / 2) for _ in range(3))]
    faces.append((99, 990, 20.0, 0.0, 0.0, 0.0, 0.9, 0.9))
    skipped = [(99, 991, None, 0.0, 0.0, 0.0, 9.0, 9.0), (99, 992, 85.0, 0.0, 0.0, 0.0, 9.0, 9.0), (99, 993, 20.0, None, 0.0, 0.0, 9.0, 9.0)]
    box = "x1 double, y1 double, x2 double, y2 double"
    got = packing.ledger(spark.createDataFrame(faces + skipped, f"building_id long, face_id long, slope double, aspect double, {box}"), spark.createDataFrame(obstacles, f"building_id long, {box}")).collect()
    panels, total = {r.face_id: r.panels for r in got}, 0
    assert len(got) == len(faces) and panels[990] == 0
    for building in range(8):
        placed, claimed = [o[1:] for o in obstacles if o[0] == building], []
        for _, face_id, slope, aspect, *own in [f for f in faces if f[0] == building]:
            c, turned = np.cos(np.radians(slope)), aspect % 180 != 0
            plane = lambda b, c=c, turned=turned: ((b[1], b[0] / c, b[3], b[2] / c) if turned else (b[0], b[1] / c, b[2], b[3] / c))
            best = slow_pack(plane(own), slope, [plane(b) for b in placed], [plane(b) for b in claimed])
            assert panels[face_id] == len(best)
            placed += [(b[1] * c, b[0], b[3] * c, b[2]) if turned else (b[0], b[1] * c, b[2], b[3] * c) for b in best]
            claimed.append(own)
            total += len(best)
    assert total > 60


def test_packing_alone_equals_the_counted_layouts(spark):
    rows = [(i, float(w), float(h), float(s), float(a), None) for i, (w, h, s, a) in enumerate((w, h, s, a) for w in (3, 8, 15, 24) for h in (4, 9, 16) for s in (2, 30) for a in (0, 90))]
    f = spark.createDataFrame(rows, "face_id long, w double, h double, slope double, aspect double, irradiance double")
    want = {r.face_id: (r.panel_count, round(r.usable_area, 6)) for r in layout.best_layouts(f).collect()}
    none = spark.createDataFrame([], "building_id long, x1 double, y1 double, x2 double, y2 double")
    got = packing.ledger(f.select(F.col("face_id").alias("building_id"), "face_id", "slope", "aspect", F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("w").alias("x2"), F.col("h").alias("y2")), none)
    assert {r.face_id: (r.panels, round(r.usable_area, 6)) for r in got.collect()} == want
    with pytest.raises(ValueError):
        packing.pack(np.array([0.0, 0.0, 400.0, 20.0]), 10.0, np.zeros((0, 4)), np.zeros((0, 4)))


def test_guards_raise(spark):
    row = lambda **k: spark.createDataFrame([({"w": 5.0, "h": 5.0, "slope": 20.0, "setback": 0.6} | k)])
    assert layout.checked_faces(row(), ("setback",)).count() == 1
    for bad in ({"slope": -1.0}, {"slope": 80.0}, {"w": 301.0}, {"setback": -0.1}, {"slope": float("nan")}):
        with pytest.raises(Exception, match="out of range"):
            layout.checked_faces(row(**bad), ("setback",)).collect()
    wide = spark.createDataFrame([(170.0,)], "extent double")
    assert wide.select(layout.image_window(F.col("extent")).alias("w")).first().w is None
    with pytest.raises(Exception, match="too large"):
        wide.select(layout.image_window(F.col("extent"), strict=True)).collect()
    lines = "file long, line_no long, cls int, coords string"
    for bad in ((1, 1, 11, "0 0 1 0 1 1"), (1, 1, 0, "0 0 1 0"), (1, 1, 0, "0 0 1 0 1 2"), (1, 1, 0, "0 0 1 0 1 nan"), (1, 1, 0, "0 0 1 0 1 1 0.5")):
        df = spark.createDataFrame([bad], lines)
        with pytest.raises(Exception, match="invalid label line"):
            curation.label_lines(df).collect()
        assert curation.label_lines(df, strict=False).count() == 0


def test_sources_are_sets(spark):
    rows = [(1, "chimney", ["rid"], None, 0.0, 0.0, 2.0, 2.0), (2, "chimney", ["height", "rid"], None, 0.0, 0.0, 2.0, 2.0), (3, "chimney", ["rid", "rid"], None, 0.0, 0.0, 2.0, 2.0), (4, "pv_installation", ["rid", "swiss"], 0.5, 0.0, 0.0, 1.0, 2.0), (5, "pv_installation", ["swiss"], 0.4, 0.0, 0.0, 2.0, 2.0), (6, "shadow", ["rid"], 0.9, 0.0, 0.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "id long, kind string, sources array<string>, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: (r.clipped_area, r.blocks_placement) for r in fusion.arbitrated(df, 2.0).collect()}
    assert got == {1: (2.0, True), 2: (4.0, True), 3: (2.0, True), 4: (2.0, True), 5: (4.0, True), 6: (4.0, False)}
    s = spark.createDataFrame([(["b", "a", "b"], "x", "y"), (None, "x", "y"), (None, None, "y"), (None, None, None)], "l array<string>, s string, m string")
    assert [r.c for r in s.select(fusion.source_set(F.col("l"), F.col("s"), F.col("m")).alias("c")).collect()] == [["a", "b"], ["x"], ["y"], ["unknown"]]


def test_parts_grow_from_the_whole_selection(spark):
    rows = [(1, 7, 0.0, 0.0, 4.0, 4.0, False), (2, 7, 5.0, 0.0, 9.0, 4.0, False), (3, 7, 60.0, 0.0, 64.0, 4.0, True), (4, 7, 65.0, 0.0, 69.0, 4.0, False), (5, 8, 0.0, 0.0, 4.0, 4.0, False), (6, 8, 20.0, 0.0, 24.0, 4.0, False)]
    df = spark.createDataFrame(rows, "id long, egid long, x1 double, y1 double, x2 double, y2 double, selected boolean")
    assert {(r.egid, r.id) for r in roofs.grown_selection(df).collect()} == {(7, 3), (7, 4), (8, 5)}
    assert {(r.egid, r.id) for r in roofs.grown_selection(df.drop("selected")).collect()} == {(7, 1), (7, 2), (8, 5)}
    unknown = spark.createDataFrame([(11, None, *rows[0][2:6], True), (12, None, *rows[0][2:6], False), (13, 0, *rows[0][2:6], True)], df.schema)
    assert {(r.egid, r.id) for r in roofs.grown_selection(df.union(unknown)).collect()} == {(7, 3), (7, 4), (8, 5), (None, 11), (0, 13)}


def test_names_and_headers(spark):
    df = spark.createDataFrame([("a_2020_2600.5-1200.25_x.png",), ("plain.png",), (None,)], "n string")
    assert [tuple(r.c) for r in df.select(keys.chip_name(F.col("n")).alias("c")).collect()] == [(2020, 2600500, 1200250), (None, None, None), (None, None, None)]
    blob = spark.createDataFrame([(bytearray(b"GP\0\x03"),), (bytearray(b"XX\0\x03"),), (bytearray(b"GP\0\x0f"),)], "b binary")
    assert [r[0] for r in blob.select(keys.wkb_offset(F.col("b"))).collect()] == [40, None, None]


def test_geotiff_tags(spark, tmp_path):
    entries = [(256, 3, 1, struct.pack("<HH", 10000, 0)), (257, 3, 1, struct.pack("<HH", 9000, 0)), (33550, 12, 3, None), (33922, 12, 6, None)]
    at, body, tail = 8 + 2 + 12 * len(entries) + 4, b"", b""
    values = {33550: struct.pack("<3d", 0.1, 0.1, 0), 33922: struct.pack("<6d", 0, 0, 0, 2600000, 1200000, 0)}
    for tag, kind, n, value in entries:
        if value is None:
            value = struct.pack("<I", at + len(tail))
            tail += values[tag]
        body += struct.pack("<HHI", tag, kind, n) + value
    (tmp_path / "a.tif").write_bytes(b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + body + b"\0" * 4 + tail)
    (tmp_path / "b.tif").write_bytes(b"not a tiff")
    got = {r.stem: r for r in files.geotiff_tags(files.binary_files(spark, str(tmp_path), "*.tif")).collect()}
    assert tuple(got["a"])[1:] == (10000, 9000, 0.1, 0.1, 2600000.0, 1200000.0) and got["b"].width is None


def test_pairs_must_be_whole(spark):
    a = spark.createDataFrame([("x", bytearray(b"1")), ("y", bytearray(b"2"))], "stem string, content binary")
    assert files.paired(a, a).count() == 2
    with pytest.raises(Exception, match="no pair for y"):
        files.paired(a, a.filter("stem = 'x'")).collect()


def test_sizes_of_a_pair_are_compared_across_formats(spark):
    def jpeg(w, h):
        frame = b"\xff\xc0\x00\x0b\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x01\x01\x11\x00"
        return b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00\xff\xff\xdb\x00\x43" + b"\x00" * 65 + frame + b"\xff\xda"

    png = lambda w, h: b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big")
    rows = lambda *r: spark.createDataFrame([(n, bytearray(c)) for n, c in r], "stem string, content binary")
    got = {r.stem: r.s for r in rows(("a", jpeg(300, 7)), ("b", png(5, 6)), ("c", b"\xff\xd8\xff\xe0\x00"), ("d", b"")).select("stem", files.image_size(F.col("content")).alias("s")).collect()}
    assert tuple(got["a"]) == (300, 7) and tuple(got["b"]) == (5, 6) and got["c"] is None and got["d"] is None
    assert files.paired(rows(("a", jpeg(5, 6))), rows(("a", png(5, 6)))).count() == 1
    with pytest.raises(Exception, match="sizes differ for a"):
        files.paired(rows(("a", jpeg(5, 6))), rows(("a", png(5, 5)))).collect()


def test_responses_that_may_be_kept(spark):
    bodies = {b"[1, 2]": True, b' {"a": {"error": 1}}': True, b'{"error": null}': False, b'["error"]': False, b'[{"error": 1}]': True, b'{"a"': False, b"5": False, b"": False}
    df = spark.createDataFrame([(200, bytearray(b), False) for b in bodies] + [(500, bytearray(b"[]"), False), (200, bytearray(b"\xff\xd8\xff"), True), (200, None, False)], "status int, body binary, picture boolean")
    got = [r.k for r in df.select(pages.storable(F.col("status"), F.col("body"), F.col("picture")).alias("k")).collect()]
    assert got == [*bodies.values(), False, True, False]


def test_label_lines_and_manifests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/f.txt").write_text("1 0 0 1 0 1 1\n2 0 0 1 0\nx 0 0 1 0 1 1\n3 0 0 2 0 1 1\n\n")
    got = files.label_file(spark, str(tmp_path / "in")).collect()
    assert [(r.cls, r.valid) for r in got] == [(1, True), (2, False), (None, False), (3, False)]
    files.write_manifests(spark.createDataFrame([("train", "a"), ("test", "b")], "split string, name string"), str(tmp_path / "out"))
    assert {(r.value, r.split) for r in spark.read.text(str(tmp_path / "out")).collect()} == {("a", "train"), ("b", "test")}


def test_streams_keep_the_latest(spark, tmp_path):
    rows = [("m", "2024-01-01 00:00:00", "ready"), ("m", "2024-01-01 00:10:00", None), ("n", "2024-01-01 00:05:00", "failed"), ("n", "2024-01-01 00:06:00", "ready")]
    spark.createDataFrame(rows, "model string, ts string, state string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("model string, ts timestamp, state string").parquet(str(tmp_path / "in"))
    q = state.last_known_stream(stream, "model", "ts", "state").writeStream.outputMode("complete").format("memory").queryName("known_states").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.model, r.known) for r in spark.table("known_states").collect()} == {("m", "ready"), ("n", "ready")}


def test_eviction_keeps_the_newest(spark):
    df = spark.createDataFrame([(i, 0, i, 1000) for i in range(5)], "id long, folder long, mtime long, size long")
    assert {r.id for r in status.evicted(df, "folder", ["mtime"], "size", 3000).filter("kept").collect()} == {2, 3, 4}


def test_selection_needs_rings(spark):
    point = spark.createDataFrame([(1, 10, ["r"]), (2, 11, ["r"]), (3, 12, ["r"])], "request long, id long, rings array<string>")
    key = spark.createDataFrame([(1, 20, ["r"]), (2, 21, ["r"]), (2, 22, [])], "request long, id long, rings array<string>")
    assert {(r.request, r.id) for r in roofs.selection(point, key).collect()} == {(1, 20), (2, 11), (3, 12)}


def test_survey_pages_end_and_fail(spark, tmp_path):
    def page(survey, offset, n, more, crs="EPSG:2056", outside=False):
        (tmp_path / survey).mkdir(exist_ok=True)
        rows = [{"id": offset + i, "x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0} for i in range(n)]
        (tmp_path / survey / f"{offset}.json").write_text(json.dumps({"offset": offset, "crs": crs, "exceededTransferLimit": more, "outside": outside, "features": rows}))

    page("a", 0, 3, True), page("a", 4000, 2, False), page("a", 8000, 5, False), page("b", 0, 0, False), page("c", 0, 4, False, outside=True)
    got = pages.survey_records(pages.read_pages(spark, str(tmp_path))).collect()
    assert sorted((r.survey, r.id, r.last) for r in got) == [("a", 0, False), ("a", 1, False), ("a", 2, False), ("a", 4000, True), ("a", 4001, True)]
    for bad in (("d", 0, 0, True), ("e", 0, 1, False, "EPSG:4326")):
        page(*bad)
        with pytest.raises(Exception, match="survey page"):
            pages.survey_records(pages.read_pages(spark, str(tmp_path / bad[0]))).collect()


def test_geometry_blobs(spark):
    def polygon(*rings):
        return b"\x01" + struct.pack("<II", 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in rings)

    outer, hole = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (1.5, 1.5)]
    head = lambda code: b"GP\0" + bytes([code * 2 + 1]) + b"\x08\x08\0\0" + b"\0" * (0, 32, 48, 48, 64)[code]
    rows = [(1, head(0) + polygon(outer, hole)), (2, head(4) + polygon(outer)), (3, b"no blob"), (4, None), (5, head(1) + polygon(outer)[:-9]), (6, head(1) + b"\x01" + struct.pack("<I", 1) + b"\0" * 16)]
    got = {r.id: r.g for r in spark.createDataFrame(rows, "id int, b binary").select("id", keys.wkb_polygon(F.col("b")).alias("g")).collect()}
    assert [[(p.x, p.y) for p in ring] for ring in got[1]] == [outer, hole] and len(got[2]) == 1 and all(got[k] is None for k in (3, 4, 5, 6))


def test_files_must_fit(spark, tmp_path):
    png = lambda w, h: b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\x08\0\0\0\0"
    rows = lambda *r: spark.createDataFrame(r, "stem string, content binary")
    assert files.paired(rows(("a", png(5, 6))), rows(("a", png(5, 6)))).count() == 1
    with pytest.raises(Exception, match="sizes differ"):
        files.paired(rows(("a", png(5, 6))), rows(("a", png(6, 5)))).collect()
    tags = lambda **k: spark.createDataFrame([{"stem": "t", "width": 10000, "height": 10000, "scale_x": 0.1, "scale_y": 0.1, "east": 1.0, "north": 2.0} | k])
    assert files.required_tags(tags()).count() == 1
    for bad in ({"width": 9999}, {"scale_x": 0.2}):
        with pytest.raises(Exception, match="not a tile"):
            files.required_tags(tags(**bad)).collect()
    rows = spark.createDataFrame([("train", "g1", 3, 0.9), ("train", "g1", 1, 1.0), ("test", "g2", 2, 0.8)], "split string, group string, instances long, conversion_iou double")
    files.write_audit(rows, str(tmp_path / "audit"))
    (r,) = spark.read.json(str(tmp_path / "audit/summary")).collect()
    assert (r.images, r.groups, r.instances, r.least_iou, r.splits.train, r.splits.val) == (3, 2, 6, 0.8, 2, 0) and spark.read.json(str(tmp_path / "audit/rows")).count() == 3
    files.write_labels(spark.createDataFrame([("train", "f1", "0 0 0 1 0 1 1"), ("val", "f2", "1 0 0 1 0 1 1")], "split string, file string, line string"), str(tmp_path / "labels"))
    assert {(r.split, r.file, r.value[0]) for r in spark.read.text(str(tmp_path / "labels")).collect()} == {("train", "f1", "0"), ("val", "f2", "1")}
    files.write_yaml(spark, ("pv", "dormer"), str(tmp_path / "yaml"))
    assert "".join(f.read_text() for f in (tmp_path / "yaml").glob("part-*")) == "path: .\ntrain: split=train\nval: split=val\ntest: split=test\nnames:\n  0: pv\n  1: dormer\n"


def test_arguments_and_windows_that_fail(spark):
    df = spark.createDataFrame([("candidate={}",)], "a string")
    got = df.select(keys.system_gate(F.col("a"), ("candidate",)).alias("g")).first().g
    assert (got.system, got.gate) == ("candidate", False) and len(got.digest) == 64
    for bad in ("other={}", "candidate"):
        with pytest.raises(Exception, match="unknown system"):
            spark.createDataFrame([(bad,)], "a string").select(keys.system_gate(F.col("a"), ("candidate",))).collect()
    tiles = spark.createDataFrame([(1, 0, 0, float("nan")), (1, 0, 1, 2.0), (2, 0, 0, 3.0), (2, 0, 1, 4.0)], "rank int, r long, c long, z double")
    ask = lambda *box: spark.createDataFrame([(7, *map(float, box))], "request long, x1 double, y1 double, x2 double, y2 double")
    assert {(r.r, r.c, r.z) for r in raster.mosaic_windows(ask(0.1, -0.9, 0.9, 0.0), tiles).collect()} == {(0, 0, 3.0), (0, 1, 2.0)}
    for box in ((0, -0.5, 0.5, 0), (50, -60, 53, -50)):
        with pytest.raises(Exception, match="no heights"):
            raster.mosaic_windows(ask(*box), tiles).collect()
        assert raster.mosaic_windows(ask(*box), tiles, strict=False).count() == 0


def cell_rows(*masks):
    return [(i, r, c) for i, m in enumerate(masks) for r, line in enumerate(m) for c, x in enumerate(line) if x == "#"]


def test_outlines_follow_their_masks(spark):
    masks = [["....", ".##.", ".##.", "...."], ["#...", ".#..", "..##", "..##"], ["####", "#..#", "#..#", "####"], ["....", "....", "....", "...."], ["##..", "....", "..##", "..##"]]
    for m in masks:
        cells = np.array([[x == "#" for x in line] for line in m])
        if cells.any() and m is not masks[4]:
            ring = surfaces.outline(cells)
            inside = surfaces.filled(ring, cells.shape)
            assert (inside[cells]).all() and inside.sum() == (16 if m is masks[2] else cells.sum())
    parts = [(i, 0 if i < 4 else (r > 1), r, c) for i, r, c in cell_rows(*masks)]
    got = {r.image: r for r in surfaces.mask_polygons(spark.createDataFrame([(i, int(p), r, c) for i, p, r, c in parts], "image long, part long, r int, c int"), 4, 4).collect()}
    assert got[0].agreement == 1.0 and got[0].lines == ["0 0.2500000 0.2500000 0.7500000 0.2500000 0.7500000 0.7500000 0.2500000 0.7500000"]
    assert got[2].agreement == 12 / 16 and len(got[4].lines) == 1 and got[4].agreement == 4 / 6


def test_simplification_by_length(spark):
    line = [(1, n, float(n), 0.3 * (n % 2)) for n in range(21)]
    df = spark.createDataFrame(line, "id long, n long, x double, y double")
    assert surfaces.simplified(df, "mask").count() == surfaces.simplified(df, "window").count() == 2
    assert surfaces.simplified(df.withColumn("y", F.col("y") * 2), "height").count() > 15
    assert [round(surfaces.TOLERANCES[k](10.0), 2) for k in ("height", "window", "mask")] == [0.2, 0.5, 0.5]


def test_a_drop_is_found_and_ridges_are_not(spark):
    """Two faces that meet in a ridge, a chimney on one, a court in the other: only the two are found."""
    rows = []
    for r in range(16):
        for c in range(24):
            z = 10 + 0.5 * min(c, 23 - c) + (2.0 if 4 <= r <= 6 and 3 <= c <= 5 else 0) - (6.0 if 6 <= r <= 12 and 15 <= c <= 20 else 0)
            rows.append((1, r, c, z, int(c >= 12)))
    g = raster.face_cores(spark.createDataFrame(rows, "image long, r int, c int, z double, face int"))
    fits = raster.consensus_planes(g.select((F.col("image") * 2 + F.col("face")).alias("image"), "r", "c", "z")).select(F.floor(F.col("image") / 2).alias("image"), (F.col("image") % 2).cast("int").alias("face"), "a", "b", "z0")
    marked = surfaces.raised_and_dropped(g, fits, fits.select("image", "face", F.lit(0.28).alias("threshold")))
    found = []
    for name in ("raised", "dropped"):
        cells = raster.closed(marked, F.col(name)).filter("v = 1")
        parts = raster.components(cells).join(cells, ["image", "r", "c"]).withColumn("depth", F.abs("residual")).withColumn("roof_area", F.lit(96.0))
        found += [(r.kind, r.cells, round(r.height, 2)) for r in surfaces.obstacles(parts, name == "dropped").collect()]
    assert found == [("chimney", 9, 2.0), ("other_obstacle", 42, 6.0)]


def test_mean_is_mirrored(spark):
    rng = np.random.default_rng(2)
    z = rng.integers(0, 9, (6, 9)).astype(float)
    df = spark.createDataFrame([(1, r, c, float(z[r, c])) for r in range(6) for c in range(9)], "image long, r int, c int, z double")
    want = np.lib.stride_tricks.sliding_window_view(np.pad(z, 2, "reflect"), (5, 5)).mean(axis=(2, 3))
    got = {(r.r, r.c): r.v for r in raster.local_mean(df, F.col("z"), 2).collect()}
    assert len(got) == 54 and all(got[r, c] == pytest.approx(want[r, c]) for r in range(6) for c in range(9))
    assert [raster.background_reach(p) for p in (1.0, 2.0, 10.0)] == [1, 3, 15]


def test_registration_finds_the_shift(spark):
    def image(n, dx, dy, low=40.0, high=68.0, step=0):
        return [(n, r, c, (high if 32 + dy <= r < 112 + dy and (32 + dx <= c < 112 + dx or step and (c - 32 - dx) % step < step // 2) else low) + (r * 13 + c * 7) % 3) for r in range(144) for c in range(144)]

    g = surfaces.edges(spark.createDataFrame(image(1, 6, -5) + image(2, 0, 0) + image(3, 0, 0, 40.0, 40.0), "image long, r int, c int, k double"), "k")
    ring = [{"x": float(x), "y": float(y)} for x, y in ((32, 32), (112, 32), (112, 112), (32, 112))]
    small = [{"x": p["x"] / 4 + 40, "y": p["y"] / 4 + 40} for p in ring]
    rings = spark.createDataFrame([(1, 0, ring), (2, 0, ring), (3, 0, ring), (4, 0, small)], "image long, part int, ring array<struct<x:double,y:double>>")
    points = registration.outline_points(rings)
    assert points.filter("image = 1").count() == 96 and points.filter("abs(nx) + abs(ny) > 1.001").count() == 0
    flat = spark.createDataFrame([(4, r, c, 0.0, 0.0) for r in range(144) for c in range(144)], "image long, r int, c int, gx double, gy double")
    cells = g.select("image", "r", "c", "gx", "gy").union(flat)
    got = {r.image: r for r in registration.registered(points, cells, rings.select("image", F.lit(72.0).alias("x"), F.lit(72.0).alias("y")), 0.25).collect()}
    assert got[1].applied and abs(got[1].dx - 6) <= 1 and abs(got[1].dy + 5) <= 1 and got[1].scale == 1.0 and got[1].support == 4
    assert not got[2].applied and not got[3].applied and got[2].reason == got[3].reason == "no_clear_improvement" and got[4].reason == "insufficient_boundary_evidence"


def test_registration_moves_faces_onto_the_image(spark):
    """Roofs of 20 m on images of 40 m: shifted, overhanging, beside an inner line, in place, and without contrast."""

    def cells(n, inner=False, plain=False):
        bright = lambda r, c: not plain and 50 <= r < 150 and 50 <= c < 150
        return [(n, r, c, 150.0 if inner and 97 <= r < 103 and 50 <= c < 150 else 58.0 if bright(r, c) else 30.0) for r in range(200) for c in range(200)]

    boxes_ = {1: (9, 12, 29, 32), 2: (9, 9, 31, 31), 3: (10, 10, 30, 30), 4: (10, 10, 30, 30), 5: (9, 12, 29, 32)}
    ring = lambda x1, y1, x2, y2: [{"x": float(x), "y": float(y)} for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]
    schema = "image long, part int, ring array<struct<x:double,y:double>>"
    image = spark.createDataFrame(cells(1) + cells(2) + cells(3, inner=True) + cells(4) + cells(5, plain=True), "image long, r int, c int, k double")
    faces = spark.createDataFrame([(n, 0, ring(*b)) for n, b in boxes_.items()], schema)
    outlines = spark.createDataFrame([(n, 0, ring(x1 * 5, (40 - y2) * 5, x2 * 5, (40 - y1) * 5)) for n, (x1, y1, x2, y2) in boxes_.items()], schema)
    middle = lambda of: spark.createDataFrame([(n, *of((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)) for n, b in boxes_.items()], "image long, x double, y double")
    found = registration.registered(registration.outline_points(outlines), surfaces.edges(image, "k", whole=True), middle(lambda x, y: (x * 5, (40 - y) * 5)), (0.2, 0.2))
    rows = {r.image: r for r in found.collect()}
    assert [rows[n].applied for n in range(1, 6)] == [True, True, False, False, False]
    assert abs(rows[1].dx * 0.2 - 1) <= 0.2 and abs(rows[1].dy * 0.2 - 2) <= 0.2 and rows[1].scale == 1.0 and abs(rows[2].scale - 20 / 22) <= 0.015
    placed = {r.image: [(p.x, p.y) for p in r.ring] for r in registration.moved(faces, found, middle(lambda x, y: (x, y)), (0.2, 0.2)).collect()}
    for n, want in ((1, (10, 10, 30, 30)), (2, (10, 10, 30, 30)), (3, boxes_[3]), (4, boxes_[4]), (5, boxes_[5])):
        assert all(abs(x - p["x"]) <= 0.25 and abs(y - p["y"]) <= 0.25 for (x, y), p in zip(placed[n], ring(*want), strict=True)), n


def test_ring_measures(spark):
    square = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 2.0}, {"x": 0.0, "y": 2.0}]
    df = spark.createDataFrame([(square,), (square[:2],)], "ring array<struct<x:double,y:double>>")
    got = [r.m for r in df.select(boxes.ring_centroid(F.col("ring")).alias("m")).collect()]
    assert (got[0].x, got[0].y) == (2.0, 1.0) and got[1] is None
    at = lambda x, y: [r.d for r in df.select(boxes.ring_distance(F.col("ring"), F.lit(x), F.lit(y)).alias("d")).collect()]
    assert at(7.0, 6.0) == [5.0, pytest.approx(45**0.5)] and at(2.0, -1.0)[0] == 1.0
    utm = spark.range(1).select(boxes.wgs84_to_utm32(F.lit(9.0), F.lit(48.0)).alias("u")).first().u
    assert utm.east == pytest.approx(500000) and utm.north == pytest.approx(5316300.2, abs=0.5)


def _some_polygons(rng, n):
    """Rings on whole places, so that they cross, touch and lie on each other."""
    return [[[rng.integers(0, 6, (rng.integers(3, 7), 2)).astype(float) for _ in range(rng.integers(1, 3))] for _ in range(2)] for _ in range(n)]


def _flat(rows):
    rings = [(i, k, r) for i, row in enumerate(rows) for k, p in enumerate(row) for r in p]
    starts = np.concatenate(([0], np.cumsum([len(r) for _, _, r in rings])))
    return overlays.Rows(len(rows), np.concatenate([r for _, _, r in rings]), starts, np.array([i for i, _, _ in rings]), np.array([k for _, k, _ in rings]))


def test_overlays_of_many_rows_are_those_of_each(monkeypatch):
    rows = _some_polygons(np.random.default_rng(5), 200)
    rows[7] = [[np.array([[0, 0], [9, 0], [9, 9], [0, 9]], float)], [np.column_stack((np.cos(np.arange(400) / 64), np.sin(np.arange(400) / 64)))]]
    for rule, alone in ((polygons.ANY, overlay.union), (polygons.BOTH, lambda r: overlay.intersection(*r)), (polygons.ALONE, lambda r: overlay.difference(r[0], r[1:])), (polygons.ODD, overlay.symmetric)):
        want, parts, areas = [alone(r) for r in rows], overlays.overlays(_flat(rows), rule), overlays.areas(_flat(rows), rule)[0]
        assert [len(p) for p in parts] == [len(w) for w in want]
        assert np.allclose(overlays.measured(parts), [overlay.area(p) for p in parts])
        assert np.allclose([overlay.area(p) for p in parts], [overlay.area(w) for w in want]) and np.allclose(areas, [overlay.area(w) for w in want])
    # rows of few edges are not taken one by one, unless they have holes
    boxes = [[[np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float) + i % 7], [np.array([[1, 1], [3, 1], [3, 3], [1, 3]], float) + i % 5]] for i in range(50)]
    monkeypatch.setattr(overlay, "overlay", None)
    assert np.allclose(overlays.areas(_flat(boxes), polygons.ANY)[0], [overlays.overlays(_flat([b]), polygons.ANY)[0] and sum(overlay.area([p]) for p in overlays.overlays(_flat([b]), polygons.ANY)[0]) for b in boxes])


def test_smallest_rectangles_of_many_rings():
    rng = np.random.default_rng(3)
    rings = [rng.integers(0, 6, (rng.integers(1, 15), 2)).astype(float) for _ in range(300)] + [np.zeros((2, 2))]
    found = overlays.smallest_rectangles(np.concatenate(rings), np.concatenate(([0], np.cumsum([len(r) for r in rings]))))
    want = np.array([overlay.smallest_rectangle(r) for r in rings])
    assert np.allclose(found[:, :2], want[:, :2]) and np.allclose(np.cos(4 * found[:, 2]), np.cos(4 * want[:, 2]))  # a square has two angles
    assert np.isnan(overlays.smallest_rectangles(np.zeros((0, 2)), np.array([0, 0]))).all()


def test_boxes_apart_from_others(spark):
    left = [(i % 3, i, float(i % 7), float(i % 5) - 2, i % 7 + 1.5, i % 5 - 0.5) for i in range(60)] + [(0, 99, None, 0.0, 1.0, 1.0)]
    right = [(k % 4, float(k % 6), float(k % 9) - 3, k % 6 + 6.0, k % 9 - 2.0) for k in range(9)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"k int, {key}x1 double, y1 double, x2 double, y2 double")
    df = spatial.apart_from(frame(left, "id int, "), frame(right, ""), 4.0, 2.0, on=("k",))
    meets = lambda a, b: a[0] == b[0] and a[2] is not None and min(a[4], b[3]) > max(a[2], b[1]) and min(a[5], b[4]) > max(a[3], b[2])
    assert {r.id for r in df.collect()} == {a[1] for a in left if not any(meets(a, b) for b in right)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan


def test_houses_of_many_parts_grow_as_those_of_few(spark, monkeypatch):
    rng = random.Random(4)
    parts = [(i, rng.randrange(9), float(x), float(y), x + 4.0, y + 4.0, rng.random() < 0.05) for i in range(150) for x, y in [(rng.randrange(0, 230, 3), rng.randrange(0, 24, 2))]]
    df = spark.createDataFrame(parts, "id long, egid long, x1 double, y1 double, x2 double, y2 double, selected boolean")
    together = sorted(map(tuple, roofs.grown_selection(df).collect()))
    assert "FlatMapGroups" not in roofs.grown_selection(df)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(roofs, "MOST_TOGETHER", 0)
    assert sorted(map(tuple, roofs.grown_selection(df).collect())) == together and len(together) > 9


def test_chips_of_one_place_are_answered_once(spark, tmp_path):
    from solarweave.plans import detections

    roofs_ = spark.range(2000).selectExpr("id AS l_orderkey", "CAST(1 AS INT) AS l_linenumber", "id % 60 AS l_partkey", "id AS l_suppkey")
    roofs_.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(3000).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    df = detections.chip_roof_overlap(spark, str(tmp_path))
    met = {r.chip: (r.n, r.area) for r in df.collect()}
    assert met and all(met[k] == met[k + 1000] == met[k + 2000] for k in met if k < 1000)
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "customer"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted((r[0], r[1], round(r[2], 6)) for r in con.execute(f"select chip, n, area from ({detections.SQL['chip_roof_overlap']})").fetchall()) == sorted((k, n, round(a, 6)) for k, (n, a) in met.items())


def test_rasterised_lines_are_those_of_the_expression(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [[(float(x), float(y)) for x, y in rng.integers(-2, 12, (rng.integers(1, 6), 2)) / 2] for _ in range(rng.integers(0, 3))]) for i in range(40)] + [(40, None)]
    df = spark.createDataFrame(rows, "id long, rings array<array<struct<x: double, y: double>>>")
    grid = df.select("id", (F.col("id") % 5).cast("int").alias("rows"), (F.col("id") % 7).cast("int").alias("columns"))
    every = df.join(grid, "id").join(spark.range(7).selectExpr("CAST(id AS INT) AS r"), F.col("r") < F.col("rows")).join(spark.range(7).selectExpr("CAST(id AS INT) AS c"), F.col("c") < F.col("columns"))
    want = sorted(map(tuple, every.filter(raster.inside_rings(F.col("rings"), F.col("c") + 0.5, F.col("r") + 0.5)).select("id", "r", "c").collect()))
    out = raster.rasterised(df, grid)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString() and len(want) > 20
    assert sorted(map(tuple, out.collect())) == want
    monkeypatch.setattr(raster, "MOST_CELLS", 10)
    assert sorted(map(tuple, raster.rasterised(df, grid).collect())) == want
