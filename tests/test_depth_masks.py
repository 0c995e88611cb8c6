"""Depth scale, masks and pose functions on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from aerolith.functions import poses, reports
from aerolith.operators import depth, masks, meshes, points


def test_smoothing_drops_an_outlier(spark):
    rows = [(1, i, s) for i, s in enumerate([2.0, 2.0, 100.0, 2.0, 2.0])]
    got = depth.aligned(spark.createDataFrame(rows, "job long, frame long, raw double")).orderBy("frame").collect()
    assert [r["smooth"] for r in got] == [2.0] * 5


def test_scales_of_known_maps(spark):
    pixels = spark.createDataFrame([(1, f, v, u, d) for f, d in ((0, 10.0), (1, 12.0)) for v in range(16) for u in range(16)], "job long, frame long, v long, u long, depth double")
    rows = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 40.0), (1, 1, 6.0, 0.0, 0.0, None)], "job long, frame long, e double, n double, up double, agl double")
    gps = {r["frame"]: r["scale_gps"] for r in depth.baseline_scale(pixels, rows, (16, 16)).collect()}
    assert gps == {0: None, 1: 3.0}  # 6 m of way for 2 units of depth
    baro = {r["frame"]: r["scale_baro"] for r in depth.barometric_scale(pixels, rows, (16, 16)).collect()}
    assert baro == {0: 4.0, 1: None}
    seen = spark.createDataFrame([(1, 0, float(i), 1.0, 2.0, 2.5 * i, 2.5, 5.0, 1.0) for i in range(5)] + [(1, 1, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0, 1.0)] * 4, "job long, frame long, ax double, ay double, az double, bx double, by double, bz double, depth double")
    sparse = depth.sparse_scale(seen).collect()
    assert [(r["frame"], r["n"]) for r in sparse] == [(0, 5)] and sparse[0]["scale_sparse"] == pytest.approx(2.5) and sparse[0]["residual"] == pytest.approx(0)
    frames = spark.createDataFrame([(1, 0, 2.5, 3.0, 4.0, 5, 0.1), (1, 1, None, 3.0, 4.0, None, None), (1, 2, None, None, 4.0, None, None), (1, 3, None, None, None, None, None)], "job long, frame long, scale_sparse double, scale_gps double, scale_baro double, n_sparse long, residual_sparse double")
    chosen = depth.chosen_scale(frames)
    assert [(r["raw"], r["mode"], r["points"]) for r in chosen.orderBy("frame").collect()] == [(2.5, "SPARSE_3D", 5), (3.0, "GPS_BASELINE", 2), (4.0, "BAROMETRIC", 1), (1.0, "MEDIAN_PROPAGATION", 0)]
    report = depth.alignment_report(depth.aligned(chosen)).first()
    assert report["mode"] == "SPARSE_3D" and report["baro_ok"] and report["frames"] == 4


def flood(cells):
    left, out = set(cells), []
    while left:
        stack = [left.pop()]
        found = list(stack)
        while stack:
            v, u = stack.pop()
            for p in [(v + i, u + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if p in left:
                    left.remove(p)
                    stack.append(p)
                    found.append(p)
        vs, us = [v for v, _ in found], [u for _, u in found]
        out.append((len(found), min(us), min(vs), max(us), max(vs)))
    return sorted(out)


@pytest.mark.parametrize("share", [0.2, 0.45, 0.7])
def test_components_equal_a_flood_fill(spark, share):
    rng = random.Random(int(share * 100))
    pixels = [(f, v, u, rng.randint(1, 2)) for f in range(2) for v in range(25) for u in range(30) if rng.random() < share]
    got = masks.components(spark.createDataFrame(pixels, "frame long, v long, u long, cls int"), 2).collect()
    for frame in range(2):
        for cls in (1, 2):
            want = [c for c in flood([(v, u) for f, v, u, k in pixels if f == frame and k == cls]) if c[0] >= 2]
            assert sorted((r["area"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in got if (r["frame"], r["cls"]) == (frame, cls)) == want


def test_object_pixels_fall_back_to_the_box(spark):
    pixels = spark.createDataFrame([(0, v, u, 5 if v == 1 else 3) for v in range(4) for u in range(4)], "frame long, v long, u long, cls int")
    boxes = spark.createDataFrame([(0, 0, 1, 0, 3, 3, 5), (0, 1, -5, 2, 1, 9, 9)], "frame long, position long, x0 int, y0 int, x1 int, y1 int, cls int")
    got = {(r["v"], r["u"]) for r in masks.object_pixels(boxes, pixels, 4, 4).collect()}
    assert got == {(1, 1), (1, 2)} | {(2, 0), (3, 0)}


def test_rotations(spark):
    one = spark.range(1).select(F.lit(30.0).alias("y"), F.lit(-20.0).alias("p"), F.lit(10.0).alias("r"))
    m = poses.euler_zyx(F.col("y"), F.col("p"), F.col("r"))
    q = one.select(*[c.alias(n) for n, c in zip("xyzw", poses.quaternion(m), strict=True)], *[c.alias(f"v{i}") for i, c in enumerate(poses.rotation_vector(m))]).first()
    assert q["x"] ** 2 + q["y"] ** 2 + q["z"] ** 2 + q["w"] ** 2 == pytest.approx(1)
    angle = 2 * math.acos(q["w"])
    assert math.sqrt(sum(q[f"v{i}"] ** 2 for i in range(3))) == pytest.approx(angle)
    half = spark.range(1).select(*[c.alias(n) for n, c in zip("xyzw", poses.quaternion([[F.lit(float(a)) for a in row] for row in ((1, 0, 0), (0, -1, 0), (0, 0, -1))]), strict=True)]).first()
    assert (abs(half["x"]), half["y"], half["z"], half["w"]) == (1.0, 0.0, 0.0, 0.0)  # half a turn about x


def test_uncertainty_and_modes(spark):
    row = spark.range(1).select(
        reports.accuracy_mode(F.lit(False), F.lit(True), F.lit(4.5), F.lit(12), F.lit(False)).alias("a"),
        reports.accuracy_mode(F.lit(False), F.lit(True), F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit(False)).alias("b"),
        reports.capped_compression(F.lit(90.0), F.lit(1920), F.lit(1080), F.lit(2.0)).alias("c"),
        poses.sigma_confidence(F.lit(0.02), F.lit(0.02), F.lit(True), F.lit(True)).alias("d"),
    ).first()
    assert (row["a"], row["b"], row["c"]) == ("GPS_DEGRADED", "GPS_IMU", 24.0) and row["d"] == pytest.approx(90.0)


def test_nearest_other_and_reindexing(spark):
    rng = random.Random(3)
    cloud = [tuple(float(rng.randint(0, 60)) for _ in range(3)) for _ in range(80)]
    cameras = [(i, *(float(rng.randint(0, 60)) for _ in range(3))) for i in range(7)]
    found = points.nearest_other(spark.createDataFrame(cloud, "x double, y double, z double"), spark.createDataFrame(cameras, "id long, x double, y double, z double"), 4.0).collect()
    want = {p: min((sum((a - b) ** 2 for a, b in zip(p, c[1:], strict=True)), c[0]) for c in cameras)[1] for p in cloud}
    assert {(r["x"], r["y"], r["z"]): r["id"] for r in found} == want
    faces = spark.createDataFrame([(0, 5, 9, 7, 0), (1, 9, 5, 11, 0), (2, 2, 5, 9, 1)], "fid long, i0 long, i1 long, i2 long, part long")
    used, again = meshes.reindexed(faces, "part")
    assert sorted((r["fid"], r["i0"], r["i1"], r["i2"]) for r in again.collect()) == [(0, 0, 2, 1), (1, 2, 0, 3), (2, 0, 1, 2)]
    assert used.count() == 7
