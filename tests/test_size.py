"""Work that stays in one task or one shuffle however many rows there are, held against plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from solarweave.functions import overlays, unions
from solarweave.operators import fusion, packing, polygons, raster, registration, spatial, surfaces


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_whole_images_are_registered_without_a_shuffle(spark):
    rng = np.random.default_rng(6)
    rows, ring = [], [{"x": float(x), "y": float(y)} for x, y in ((20, 20), (80, 20), (80, 80), (20, 80))]
    for n, (dx, dy) in enumerate(((3, -4), (0, 0), (5, 2))):
        z = rng.integers(0, 4, (100, 110)) + 30
        z[20 + dy : 80 + dy, 20 + dx : 80 + dx] += 50
        rows.append((n, 110, z.astype(float).ravel().tolist(), [ring], 50.0, 50.0))
    rows.append((3, 110, [30.0] * 11000, [ring[:2]], 50.0, 50.0))
    images = spark.createDataFrame(rows, "image long, width int, values array<double>, rings array<array<struct<x:double,y:double>>>, x double, y double")
    got = registration.registered_images(images, 0.5)
    assert "Exchange" not in plan_of(got)
    cells = images.select("image", F.posexplode("values").alias("i", "k")).select("image", F.floor(F.col("i") / 110).cast("int").alias("r"), (F.col("i") % 110).cast("int").alias("c"), "k")
    points = registration.outline_points(images.select("image", F.lit(0).alias("part"), F.col("rings")[0].alias("ring")))
    want = registration.registered(points, surfaces.edges(cells, "k", whole=True), images.select("image", "x", "y"), 0.5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    found = {r.image: r for r in got.collect()}
    assert [(found[n].dx, found[n].dy, found[n].applied) for n in (0, 2)] == [(3, -4, True), (5, 2, True)] and found[3].reason == "insufficient_boundary_evidence"


def test_faces_packed_together_equal_faces_packed_alone(monkeypatch):
    rng = np.random.default_rng(4)
    n = 160
    face = np.column_stack((rng.integers(0, 6, (n, 2)), rng.integers(0, 6, (n, 2)) + rng.integers(2, 22, (n, 2)))).astype(float)
    slope = rng.choice([0.0, 10.0, 40.0], n)
    boxes = lambda m: np.column_stack((low := rng.integers(0, 36, (m, 2)) / 2, low + rng.choice([0.5, 1.0, 6.0], (m, 2))))
    around, covered = np.sort(rng.integers(0, n, 500)), np.sort(rng.integers(0, n, 120))
    obstacles, claimed = boxes(500), boxes(120)
    want = [packing.pack(face[i], slope[i], obstacles[around == i], claimed[covered == i]) for i in range(n)]
    monkeypatch.setattr(packing, "pack", lambda *_: pytest.fail("packed alone"))
    panels, usable, surface = packing.packed(face, slope, around, obstacles, covered, claimed)
    assert panels.tolist() == [len(w[0]) for w in want] and panels.sum() > 1000
    assert usable == pytest.approx([w[1] for w in want]) and surface == pytest.approx([w[2] for w in want])
    monkeypatch.undo()
    monkeypatch.setattr(packing, "MANY", 3)
    assert packing.packed(face, slope, around, obstacles, covered, claimed)[0].tolist() == panels.tolist()


def test_groups_folded_together_equal_groups_folded_alone(monkeypatch):
    rng = np.random.default_rng(8)
    size = rng.integers(1, 12, 400)
    starts = np.cumsum(size) - size
    low = rng.integers(0, 8, (size.sum(), 2)) / 2
    boxes = np.column_stack((low, low + rng.integers(1, 5, (len(low), 2)) / 2))
    want = []
    for a, m in zip(starts.tolist(), size.tolist(), strict=True):
        want += [([a + i for i in members], area) for members, area in fusion._fold(boxes[a : a + m])]
    calls, plain = [], fusion._fold
    monkeypatch.setattr(fusion, "_fold", lambda b: calls.append(len(b)) or plain(b))
    group, turn, area = fusion._merged(boxes, starts)
    assert min(calls) > fusion.FEW and len(calls) < len(size) / 2
    got = []
    for g in np.unique(group).tolist():
        own = np.flatnonzero(group == g)
        got.append((own[np.argsort(turn[own], kind="stable")].tolist(), area[own[0]]))
    assert sorted(got) == sorted(want) and len(want) < len(boxes) - 300


def test_components_across_tiles_equal_those_of_a_search(spark, monkeypatch):
    """Masks of many tiles of 4 x 4, with repeated cells: parts that wind through tiles are one."""
    rng = np.random.default_rng(5)
    masks = {n: rng.random((19, 23)) < p for n, p in ((1, 0.3), (2, 0.42), (3, 0.9))}
    masks[4] = np.zeros((3, 3), bool)
    masks[4][0, 2] = masks[4][1, 1] = True
    want = {}
    for n, mask in masks.items():
        for start in map(tuple, np.argwhere(mask).tolist()):
            if (n, *start) in want:
                continue
            todo = [start]
            while todo:
                r, c = todo.pop()
                if 0 <= r < mask.shape[0] and 0 <= c < mask.shape[1] and mask[r, c] and (n, r, c) not in want:
                    want[n, r, c] = (n, *start)
                    todo += [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    df = spark.createDataFrame([*want, (1, *[k for k in want if k[0] == 1][0][1:])], "image long, r int, c int")
    rounds = []
    monkeypatch.setattr(raster, "connected_components", lambda e, plain=raster.connected_components: rounds.append(1) or plain(e))
    for tile, some in ((10, 0), (2, 1)):
        monkeypatch.setattr(raster, "TILE", tile)
        if tile == 2:
            # workers import the module anew, so the size goes with the function
            monkeypatch.setattr(raster, "_labelled", tiled(raster._labelled, tile))
        got = [((r.image, r.r, r.c), (r.component.image, r.component.r, r.component.c)) for r in raster.components(df).collect()]
        assert dict(got) == want and len(got) == len(want) + 1 and len(rounds) == some


def tiled(run, tile):
    def each(batches):
        from solarweave.operators import raster as own

        own.TILE = tile
        try:
            yield from run(batches)
        finally:
            own.TILE = 10

    return each


def test_masks_are_dealt_to_several_tasks(spark):
    parts = spark.createDataFrame([(i, 0, r, c) for i in range(200) for r in range(2) for c in range(2)], "image long, part long, r int, c int")
    out = surfaces.mask_polygons(parts, 4, 4)
    assert out.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 3
    assert out.filter("agreement = 1 and size(lines) = 1").count() == 200


def test_visible_faces_deal_their_parts_once(spark):
    rows = [(i // 4, i, float(i % 7 * 3), float(i % 5 * 2), float(i % 7 * 3 + 9), float(i % 5 * 2 + 8)) for i in range(40)]
    own = spark.createDataFrame(rows, "b long, f long, x1 double, y1 double, x2 double, y2 double")
    plain, once = (spatial.union_area(own, "b", size=4.0, once=o) for o in (False, True))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, once.collect()))
    assert plan_of(once).count("REPARTITION_BY_COL") and "REPARTITION_BY_COL" in plan_of(surfaces.visible_area(own, "b", "f", 16.0))


def test_polygons_packed_together_equal_polygons_packed_alone(monkeypatch):
    rng = np.random.default_rng(12)
    faces, obstacles, claimed = [], [], []
    box = lambda x, y, w, h: np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float)
    for n in range(60):
        w, h = rng.integers(5, 26), rng.integers(4, 17)
        outline = [np.array([[0, 0], [w, 0], [w, h / 2], [w / 2, h / 2], [w / 2, h], [0, h]], float)]
        faces.append(outline if n % 3 else [*outline, box(1.5, 1.5, 1, 0.5)])
        obstacles.append([[box(x, y, 0.5, 0.5)] for x, y in rng.integers(1, 5, (n % 3, 2))])
        claimed.append([[box(-1, -1, 3, 20)]] if n % 4 == 0 else [[box(-1, -1, 40, 40)]] if n == 5 else [])
    slope, azimuth = rng.choice([0.5, 3.0, 20.0, 60.0], 60), rng.integers(0, 360, 60).astype(float)
    want = [packing.pack_polygon(*z) for z in zip(faces, slope, azimuth, obstacles, claimed, strict=True)]
    alone = []
    plain = packing.pack_polygon
    monkeypatch.setattr(packing, "pack_polygon", lambda *a: alone.append(a) or plain(*a))
    got = packing.packed_polygons(faces, slope, azimuth, [[packing.overlay.repaired(o) for o in some] for some in obstacles], claimed)
    assert len(alone) < 30 and sum(len(w[0]) for w in want) > 300 and len(want[5][0]) == 0
    for w, g in zip(want, got, strict=True):
        assert len(w[0]) == len(g[0]) and g[0].ravel() == pytest.approx(w[0].ravel()) and g[1:] == pytest.approx(w[1:])


def test_faces_of_a_polygon_building_keep_what_earlier_ones_own(spark):
    ring = lambda x, y, w, h: [[{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]]
    faces = [(b, f, 20.0, 30.0 * f, ring(4 * f, f, 10, 9)) for b in range(3) for f in range(3)]
    obstacles = [(0, ring(3, 3, 1, 1)), (1, None), (9, ring(0, 0, 1, 1))]
    kind = "array<array<struct<x:double,y:double>>>"
    got = packing.polygon_ledger(spark.createDataFrame(faces, f"building_id long, face_id long, slope double, azimuth double, rings {kind}"), spark.createDataFrame(obstacles, f"building_id long, rings {kind}"))
    plain = lambda rings: [np.array([(p["x"], p["y"]) for p in r]) for r in rings]
    want = {}
    for b in range(3):
        placed, claimed = [plain(o) for k, o in obstacles if k == b and o], []
        for _, f, slope, azimuth, rings in faces[3 * b : 3 * b + 3]:
            best, *areas = packing.pack_polygon(plain(rings), slope, azimuth, placed, claimed)
            placed, claimed = placed + [[m] for m in best], [*claimed, plain(rings)]
            want[b, f] = (f + 1, len(best), *areas)
    assert sum(w[1] for w in want.values()) > 30
    for r in got.collect():
        assert (r.place, r.panels, r.usable_area, r.surface_area) == pytest.approx(want.pop((r.building_id, r.face_id))) and len(r.modules) == r.panels
    assert not want


def test_cells_are_swept_together_and_open_groups_are_let_go(spark, monkeypatch):
    rng = np.random.default_rng(5)
    low = rng.integers(0, 80, (3000, 2)) / 8
    boxes = np.column_stack((low, low + rng.integers(1, 30, (3000, 2)) / 8))
    key = np.concatenate((np.zeros(1500, int), rng.integers(1, 300, 1500)))
    rows = [(None if k == 7 else f"k{k}", *map(float, b)) for k, b in zip(key, boxes, strict=True)]
    df = spark.createDataFrame(rows, "k string, x1 double, y1 double, x2 double, y2 double").repartition(5)
    want = {r.k: r.union_area for r in spatial.union_area(df, "k").collect()}
    summed = spatial.union_area(df, "k", size=4.0)
    assert plan_of(summed).count("Exchange hashpartitioning") <= 2 and "Window" not in plan_of(summed)
    assert {r.k: r.union_area for r in summed.collect()} == want
    # one group in many batches, of which few boxes are held
    monkeypatch.setattr(spatial, "MOST_HELD", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r.k: r.part for r in spatial._group_areas(df.na.drop(), ["k"], ("k",)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def covered(rows, windows):
    """unions.covered of rows of polygons, each a list of rings."""
    flat = overlays.listed(rows)
    polygon = np.cumsum(np.concatenate(([0], (np.diff(flat.row) != 0) | (np.diff(flat.polygon) != 0))))
    edges = np.column_stack((flat.xy, flat.xy[overlays.following(flat.starts, len(flat.xy))]))
    return unions.covered(edges, np.repeat(polygon, np.diff(flat.starts)), flat.row[np.unique(polygon, return_index=True)[1]], windows)


def test_unions_of_many_groups_are_those_of_the_arrangement():
    rng = np.random.default_rng(21)
    rings = lambda n, most: [rng.integers(0, most, (rng.integers(3, 7), 2)).astype(float) for _ in range(n)]
    rows = [[rings(rng.integers(1, 3), 6) for _ in range(rng.integers(1, 6))] for _ in range(150)] + [[rings(1, 20) for _ in range(28)]]
    low = rng.integers(-1, 4, (len(rows), 2)).astype(float)
    windows = np.column_stack((low, low + rng.integers(1, 9, (len(rows), 2))))
    corners = [[[w[[[0, 1], [2, 1], [2, 3], [0, 3]]]]] for w in windows]
    want = overlays.areas(overlays.merged(overlays.listed(corners), overlays.listed(rows)), polygons.BOTH)[0]
    assert np.allclose(covered(rows, windows), want) and want.sum() > 500
    far = np.array([2.6e6, 1.2e6])
    assert np.allclose(covered([[[r + far for r in p] for p in row] for row in rows], windows + np.tile(far, 2)), want)


def test_a_group_of_very_many_polygons_is_halved_until_one_holds_a_part():
    """1,000 slanted boxes in one place; pieces times polygons would be some hundred million flags."""
    rng = np.random.default_rng(22)
    low = rng.integers(0, 80, (1000, 2))
    high, held = low + rng.integers(1, 30, (1000, 2)), np.zeros((120, 120), bool)
    for (a, b), (c, d) in zip(low, high, strict=True):
        held[a:c, b:d] = True
    at = lambda x, y: np.array([3 * x + y, 2 * y - x]) / 8
    boxes = [[np.stack((at(a, b), at(c, b), at(c, d), at(a, d)))] for (a, b), (c, d) in zip(low, high, strict=True)]
    assert covered([boxes + boxes], np.array([[-99.0, -99, 99, 99]]))[0] == pytest.approx(held.sum() * 7 / 64)


def test_small_keys_are_united_whole_and_large_ones_by_cells(spark, monkeypatch):
    rng = np.random.default_rng(23)
    rows = []
    for n in range(1300):
        key = None if n % 13 == 0 else "hot" if n % 2 else f"k{n % 200}"
        x, y = (rng.random(2) * (12 if key == "hot" else 40)).tolist()
        w, h = (rng.integers(1, 8, 2)).tolist()
        rows.append((key, [[{"x": 3 * a + b, "y": 2 * b - a} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]]))
    point = {"x": 1.0, "y": 1.0}
    rows += [("none", None), ("k2", [None]), ("k2", []), ("k2", [[point, {"x": float("nan"), "y": 0.0}, point]]), ("flat", [[point, point, point]])]
    df = spark.createDataFrame(rows, f"k string, rings {polygons.RINGS}").repartition(5)
    whole = polygons.union_area(df, "k", size=16.0)
    plan = plan_of(whole)
    assert plan.count("Exchange hashpartitioning") == 1 and "cell_x" not in plan and "collect_list" not in plan
    want = {r.k: r.union_area for r in whole.collect()}
    assert want["flat"] == 0 and "none" not in want and len(want) == 103
    plain = [np.array([(p["x"], p["y"]) for p in r[1][0]]) for r in rows if r[0] == "k2" and r[1] and r[1][0] and len(r[1][0]) == 4]
    assert want["k2"] == pytest.approx(overlays.areas(overlays.listed([[[p] for p in plain]]), polygons.ANY)[0][0])
    # keys of more than 20 go by cells, of which few polygons are held
    monkeypatch.setattr(polygons, "MANY", 20)
    monkeypatch.setattr(polygons, "MOST_DEALT", 50)
    monkeypatch.setattr(polygons, "MOST_HELD", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        cells = polygons.union_area(df, "k", size=16.0)
        assert "cell_x" in plan_of(cells)
        got = {r.k: r.union_area for r in cells.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == pytest.approx(want) and want["hot"] > 1000


def test_moves_of_an_outline_serve_all_its_images(monkeypatch):
    """Sums of all moves against plain loops over them, with normals of any angle, points halfway between lines and some that leave the image."""
    rng = np.random.default_rng(31)
    h, w, across, down = 40, 46, 0.8, 1.0
    angle = rng.choice(np.arange(7) * 0.9, 80)
    points = np.column_stack((rng.integers(0, 2 * w, 80) / 2, rng.integers(0, 2 * h, 80) / 2, np.cos(angle), np.sin(angle)))
    points = np.concatenate((points, points + [0.25, 0, 0, 0], [[float(x), 20.0, 0.0, 1.0] for x in range(5, 41)]))
    kept = points[(points[:, 0] >= 5) & (points[:, 0] < w - 5) & (points[:, 1] >= 4) & (points[:, 1] < h - 4)]
    centre = (70.0, -30.0)  # far off, so that small scales lay points beyond the border
    both = [registration._Moves((h, w), points, centre, across, down)]
    monkeypatch.setattr(registration, "MOST_PLACES", 0)
    both.append(registration._Moves((h, w), points, centre, across, down))
    assert both[0].kept and not both[1].kept and both[0].points == len(kept) > 60
    for _ in range(2):
        gx, gy = rng.normal(0, 60, (2, h, w))
        want = {}
        for step in range(registration.STEPS + 1):
            x, y = (centre[k] + (kept[:, k] - centre[k]) * (0.9 + step / 100) for k in (0, 1))
            y = np.where(y - np.floor(y) == 0.5, y, np.rint(y))
            for dx in range(-5, 6):
                for dy in range(-4, 5):
                    c, r = np.rint(x + dx).astype(int), np.rint(y + dy).astype(int)
                    if np.hypot(dx * across, dy * down) > 4 or not ((r >= 0) & (r < h)).any():
                        continue
                    sums = [0, 0, 0, 0]
                    for i, j, (nx, ny) in zip(r.tolist(), c.tolist(), kept[:, 2:].tolist(), strict=True):
                        if 0 <= i < h and 0 <= j < w:
                            sums[2 + (ny > 0) if abs(ny) > abs(nx) else int(nx > 0)] += round(min(abs(gx[i, j] * nx + gy[i, j] * ny), 100.0) * 65536)
                    want[dx, dy, step] = sums
        for moves in both:
            assert {tuple(m): s for m, s in zip(moves.moves.tolist(), moves.sums(gx, gy).tolist(), strict=True)} == want
        top = max(want, key=lambda m: (sum(want[m]), *m))
        assert registration._scored(both[0], gx, gy, across, down)[2] == [sum(want[top]), *top, *want[top]]


def test_samples_are_made_once_an_image_and_images_by_lines(spark, tmp_path):
    ring = [{"x": float(x), "y": float(y)} for x, y in ((10, 10), (70, 10), (70, 70), (10, 70))]
    df = spark.createDataFrame([([ring],), ([],), (None,)], "rings array<array<struct<x:double,y:double>>>").repartition(1)
    plan = df.select(registration.samples(F.col("rings")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(rings#") == 1
    got = [r.s for r in df.select(registration.samples(F.col("rings")).alias("s")).collect()]
    assert sorted(-1 if s is None else len(s) for s in got) == [-1, 0, 68]
    from solarweave.plans import surfaces as plans

    rng = np.random.default_rng(7)
    z = [[float(np.float32(v)) for v in rng.normal(0, 0.3, 64)] for _ in range(6)]
    spark.createDataFrame([*zip((-39, -7, 0, 5, 8, 20), z, strict=True)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    images = []
    plain = registration.registered_images

    def seen(df, metres):
        images.extend(df.select("image", "values").collect())
        return plain(df, metres)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(registration, "registered_images", seen)
        plans.registration(spark, str(tmp_path))
    for image, values in images:
        v, less, rest = z[(-39, -7, 0, 5, 8, 20).index(image)], 3 * (image % 7 == 0), lambda n: int(np.fmod(image, n))  # noqa: B023
        for r in range(80):
            for c in range(80):
                roof = rest(6) != 5 and 10 + less <= c - rest(11) + 5 <= 69 - less and 10 + less <= r - rest(5) + 2 <= 69 - less
                k = np.floor(abs(v[r // 10 * 8 + c // 10]) * 24)
                red, green, blue = (x + k for x in ((80, 55, 40) if roof else (30, 30, 30)))
                assert values[r * 80 + c] == np.floor(red * 0.299 + green * 0.587 + blue * 0.114 + 0.5), (image, r, c)
    assert len(images) == 6


def _odd_boxes(seed):
    """Boxes of keys of few and of many, with null keys and corners, corners that are no number or out of order, and rows that come twice."""
    rng = np.random.default_rng(seed)
    rows = []
    for n in range(260):
        x, y = (rng.integers(-20, 60, 2) / 4).tolist()
        w, h = (rng.integers(1, 24, 2) / 4).tolist()
        rows.append((n % 200, None if n % 31 == 0 else "many" if n % 3 == 0 else f"k{n % 40}", x, y, x + w, y + h))
    odd = [(300, "k1", None, 0.0, 4.0, 4.0), (301, "k1", 0.0, 0.0, float("nan"), 4.0), (302, "many", float("nan"), 0.0, 4.0, 4.0), (303, "k2", 4.0, 4.0, 0.0, 0.0), (304, "k2", 1.0, 1.0, 1.0, 5.0)]
    return [*rows, *rows[:20], *odd]


def test_boxes_of_keys_of_few_are_dealt_once_and_meet_as_by_cells(spark, monkeypatch):
    a, b = (spark.createDataFrame(_odd_boxes(seed), "id long, k string, x1 double, y1 double, x2 double, y2 double") for seed in (1, 2))
    found = lambda df: sorted((r.a_id, r.b_id, r.a_k, repr(r.overlap)) for r in df.collect())
    for left, right in ((a, b), (a, a)):
        cells = spatial.overlap_join(left, right, 2.0, on=("k",))
        want = found(cells)
        assert "Generate explode" in plan_of(cells) and len(want) > 300
        monkeypatch.setattr(spatial, "FEW", 10_000)
        few = spatial.overlap_join(left, right, 2.0, on=("k",), counted=True)
        assert "Generate explode" not in plan_of(few) and "cell_x" not in plan_of(few)
        monkeypatch.setattr(spatial, "FEW", 40)
        some = spatial.overlap_join(left, right, 2.0, on=("k",), counted=True)
        assert "Generate explode" in plan_of(some) and "__crowded" in plan_of(some) and some.columns == few.columns == cells.columns
        monkeypatch.setattr(spatial, "MOST_CROWDED", 0)
        every = spatial.overlap_join(left, right, 2.0, on=("k",), counted=True)
        assert "__crowded" not in plan_of(every)
        assert found(few) == found(some) == found(every) == want
        if left is right:  # shuffled once
            assert "ReusedExchange" in plan_of(few) and "ReusedExchange" in plan_of(some)
        monkeypatch.undo()


def _square(x1, y1, x2, y2):
    return [[{"x": float(x), "y": float(y)} for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]]


def test_covers_are_put_together_as_they_come(spark, monkeypatch):
    rng = np.random.default_rng(24)
    polygons_ = [(f"k{n}", _square(0, 0, 8, 8)) for n in range(40)]
    polygons_ += [("k3", _square(0, 0, 8, 8)), ("k4", _square(20, 20, 24, 24)), ("k5", None), ("k6", []), (None, _square(0, 0, 2, 2)), ("bare", _square(1, 1, 4, 4))]
    boxes = [(None if n % 50 == 0 else f"k{n % 7 if n % 3 else n % 40}", *(p := rng.integers(0, 10, 2).tolist()), *(p + rng.integers(1, 4, 2)).tolist()) for n in range(600)]
    boxes += [("k4", 21, 20, 22, 24), ("alone", 0, 0, 3, 3)]
    covers = [(k, _square(*box)) for k, *box in boxes] + [("k1", None), ("k2", [])]
    schema = f"k string, rings {polygons.RINGS}"
    df, over = spark.createDataFrame(polygons_, schema).repartition(3), spark.createDataFrame(covers, schema).repartition(5)
    want = []
    for k, rings in polygons_:
        held = {(i, j) for i in range(int(rings[0][0]["x"]), int(rings[0][2]["x"])) for j in range(int(rings[0][0]["y"]), int(rings[0][2]["y"]))} if rings else set()
        gone = {(i, j) for q, x1, y1, x2, y2 in boxes if k is not None and q == k for i in range(x1, x2) for j in range(y1, y2)}
        want.append((str(k), float(len(held - gone))))
    for few in (10_000, 20):
        monkeypatch.setattr(spatial, "FEW", few)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            out = polygons.free_parts(df, over, "k", 4.0)
            plan = plan_of(out)
            got = sorted((str(r.k), round(r.area, 9)) for r in out.collect())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == sorted(want) and sum(a for _, a in want) > 300
        # no aggregate holds and sorts the covers once more
        assert "collect_list" not in plan and "Aggregate" not in plan and plan.count("MapInArrow") == 1
        assert ("Generate explode" in plan) == (few == 20)


def test_polygons_are_clipped_without_a_copy_for_each_cell(spark, monkeypatch):
    rng = np.random.default_rng(25)
    boxes = [(n % 150, None if n % 40 == 0 else n % 9 if n % 2 else 77, *(p := rng.integers(0, 12, 2).tolist()), *(p + rng.integers(1, 6, 2)).tolist()) for n in range(200)]
    schema = f"id long, k long, rings {polygons.RINGS}"
    left = spark.createDataFrame([*((i, k, _square(*box)) for i, k, *box in boxes), (900, 1, None), (901, 1, [])], schema)
    roofs_ = [(0, k, x, 0, x + 4, 7) for k in (*range(9), 77, None) for x in (0, 3)]
    right = spark.createDataFrame([(i, k, _square(*box)) for i, k, *box in roofs_], schema)
    side = lambda a, b, n: max(0, min(a[2 + n], b[2 + n]) - max(a[n], b[n]))
    areas = [(i, k, side(p, q, 0) * side(p, q, 1)) for i, k, *p in boxes for _, r, *q in roofs_ if k is not None and k == r]
    want = sorted((i, k, float(a)) for i, k, a in areas if a > 1)
    for few in (10_000, 30):
        monkeypatch.setattr(spatial, "FEW", few)
        out = polygons.clipped(left, right, 4.0, on=("k",), least=1.0)
        assert sorted((r.a_id, r.a_k, round(r.area, 9)) for r in out.collect()) == want and len(want) > 80
        assert ("Generate explode" in plan_of(out)) == (few == 30)
    assert "Generate explode" in plan_of(polygons.clipped(left, right, 4.0))


def test_boxes_of_an_order_meet_by_order_and_kind(spark, tmp_path):
    from solarweave.plans import polygons as plans

    rows = spark.range(240).selectExpr("CASE WHEN id % 37 = 0 THEN NULL ELSE id % 50 END AS l_orderkey", "CAST(id % 4 AS INT) AS l_linenumber", "id * 7 % 90 AS l_partkey", "id * 5 % 60 AS l_suppkey")
    rows.union(rows.limit(30)).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = plans.polygon_overlay(spark, str(tmp_path))
    assert "Generate explode" not in plan_of(df)
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    names = ("a_id", "b_id", "whole", "both", "first", "either", "parts")
    want = sorted(con.execute("select {} from ({})".format(", ".join(f'"{c}"' for c in names), plans.SQL["polygon_overlay"])).fetchall())
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == want and len(want) > 20
