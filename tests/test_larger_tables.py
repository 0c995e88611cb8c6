"""What made queries fail on larger tables: work that grew with copies of one thing, and numbers beyond their types."""

import random

import pytest
from pyspark.sql import functions as F

from aerolith.operators import masks, patches, points, scratch, surfaces, tracks
from aerolith.operators.meshes import with_corners
from aerolith.plans import scenes, views
from tests.test_surfaces import FACE, VERTEX, edge_counts, euler, grid

SMALL = "/root/testdata/sf0.001"


def iou(p, q):
    w, h = max(0, min(p[2], q[2]) - max(p[0], q[0])), max(0, min(p[3], q[3]) - max(p[1], q[1]))
    union = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - w * h
    return w * h / union if union > 0 else 0.0


def test_boxes_at_one_place_are_compared_once(spark):
    rng = random.Random(5)
    rows = [(k % 2, k, [x := rng.randrange(-40, 40, 8), y := rng.randrange(-40, 40, 8), x + rng.randrange(0, 3) * 20, y + rng.randrange(0, 3) * 20]) for k in range(400)]
    rows += [(0, 1000 + k, [7, 7, 7, 90]) for k in range(50)] + [(1, 7, [0, 0, 40, 40]), (1, 9, [0, 0, 40, 40])]
    boxes = spark.createDataFrame(rows, "frame long, id long, box array<long>")
    places = tracks.shapes(boxes, "frame", "id")
    assert places.count() == len({(f, *b) for f, _, b in rows if b[2] > b[0] and b[3] > b[1]}) < len(rows) / 2
    want = sorted((f, a, b, iou(p, q)) for f, a, p in rows for g, b, q in rows if f == g and a < b and iou(p, q) >= 0.3)
    assert sorted(map(tuple, tracks.overlapping(boxes, "frame", "id", 0.3).collect())) == want
    rounded = tracks.overlapping(boxes, "frame", "id", 0.3, size=11, digits=2)
    assert sorted(r[:3] for r in rounded.collect()) == [r[:3] for r in want] and {r["iou"] for r in rounded.collect()} == {round(r[3], 2) for r in want}


def test_cameras_at_one_place_are_searched_once(spark, monkeypatch):
    sizes = {}

    class Counted(scratch.Workspace):
        def cut(self, df, name):
            out = super().cut(df, name)
            sizes[name] = out.count()
            return out

    monkeypatch.setattr(points, "Workspace", Counted)
    rng = random.Random(6)
    places = [tuple(float(rng.randrange(20)) for _ in "xyz") for _ in range(12)]
    cameras = [(k, *rng.choice(places)) for k in range(300)]
    cloud = [tuple(float(rng.randrange(60)) for _ in "xyz") for _ in range(60)]
    found = points.nearest_other(spark.createDataFrame(cloud, "x double, y double, z double"), spark.createDataFrame(cameras, "id long, x double, y double, z double"), 4.0)
    want = {p: min((sum((a - b) ** 2 for a, b in zip(p, c[1:], strict=True)), c[0]) for c in cameras) for p in cloud}
    assert {(r["x"], r["y"], r["z"]): r["id"] for r in found.collect()} == {p: k for p, (_, k) in want.items()}
    assert sizes["others"] == len({c[1:] for c in cameras})


def test_patches_share_the_work_of_a_mesh(spark, monkeypatch):
    rng = random.Random(8)
    faces, vertices = grid(40, 60, {(rng.randrange(40), rng.randrange(60)) for _ in range(60)})
    rounds = []
    monkeypatch.setattr(surfaces, "pitch", lambda placed: rounds.append(patches.pitch(placed, 900)) or rounds[-1])
    monkeypatch.setattr(surfaces, "_collapsible", lambda *a: pytest.fail("patches got no further"))
    seen = []
    monkeypatch.setattr(surfaces, "collapsed", lambda *a: seen.append(patches.collapsed(*a)) or seen[-1])
    f, v = spark.createDataFrame(faces, FACE).selectExpr("*", "fid % 7 AS cls"), spark.createDataFrame(vertices, VERTEX)
    target = len(faces) // 5
    small, corners = surfaces.decimate(f, v, target, ("cls",))
    rows = [tuple(r) for r in small.collect()]
    assert abs(len(rows) - target) <= 0.03 * target and 2 <= len(seen) <= 8
    assert rounds[0] < 30 and len({r["fid"] for r in small.collect()}) == len(rows)
    assert set(edge_counts([r[:4] for r in rows]).values()) <= {1, 2} and euler([r[:4] for r in rows]) == euler(faces)
    assert all(r[4] == r[0] % 7 for r in rows) and {r["vid"] for r in corners.collect()} == {i for r in rows for i in r[1:4]}


def test_a_mesh_at_one_place_has_no_patches(spark):
    f = spark.createDataFrame([(k, k, k + 1, k + 2) for k in range(6)], FACE)
    v = spark.createDataFrame([(k, 1.0, 2.0, 3.0) for k in range(8)], VERTEX)
    assert patches.pitch(with_corners(f, v)) is None


def test_alike_boxes_are_unfolded_once(spark):
    rng = random.Random(9)
    pixels = [(f, v, u, rng.randint(1, 4)) for f in range(2) for v in range(9) for u in range(9) if rng.random() < 0.8]
    boxes = [(k % 2, k, x := rng.randrange(-2, 6, 3), y := rng.randrange(-2, 6, 3), x + 3, y + 2, rng.randint(1, 6)) for k in range(600)]
    boxes += [(0, 4000, 0, 0, 2, 2, 9), (0, 4000, 6, 6, 9, 9, 4), (1, 4000, 0, 0, 2, 2, 9), (1, 4000, 0, 0, 2, 2, 9)]
    grouped = {}
    for f, k, x0, y0, x1, y1, cls in boxes:
        x0, y0 = max(0, x0), max(0, y0)
        inside = {(f, v, u) for v in range(y0, max(y0 + 1, min(9, y1))) for u in range(x0, max(x0 + 1, min(9, x1)))}
        own, whole = grouped.setdefault((f, k), (set(), set()))
        own.update(p for p in inside if (*p, cls) in pixels)
        whole.update(inside)
    b = spark.createDataFrame(boxes, "frame long, position long, x0 int, y0 int, x1 int, y1 int, cls int")
    got = masks.object_pixels(b, spark.createDataFrame(pixels, "frame long, v long, u long, cls int"), 9, 9)
    assert {tuple(r) for r in got.collect()} == {p for own, whole in grouped.values() for p in own or whole}
    assert masks._objects(b).count() == len({(x[0], *x[2:]) for x in boxes[:600]}) + 3


@pytest.fixture(scope="module")
def many_orders(spark, tmp_path_factory):
    """The smallest tables with orders, parts and suppliers numbered as in 6 GB."""
    d = str(tmp_path_factory.mktemp("many"))
    spark.read.parquet(f"{SMALL}/part.parquet").write.parquet(f"{d}/part.parquet")
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    lines.withColumns({"l_orderkey": F.col("l_orderkey") + 53_999_700, "l_partkey": F.col("l_partkey") + 7_199_700, "l_suppkey": F.col("l_suppkey") + 359_700}).write.parquet(f"{d}/lineitem.parquet")
    return d


def test_faces_of_very_many_orders(spark, many_orders):
    base, far = ({(r["i0"], r["i1"], r["i2"], r["fid"]) for r in views.view(spark, d, "faces").collect()} for d in (SMALL, many_orders))
    more = ((53_999_700 * 8 * 1_000_000 + 7_199_700) * 10_000 + 359_700) * 4
    assert far == {(i0, i1, i2, fid + more - 2**64) for i0, i1, i2, fid in base}  # all numbers were shifted by a multiple of 300
    small, large = (sorted(tuple(r)[1:] for r in scenes.view_selection(spark, d).fillna(-1).orderBy("fid").collect()) for d in (SMALL, many_orders))
    assert small == large
    assert sorted(scenes.view_utilisation(spark, SMALL).collect()) == sorted(scenes.view_utilisation(spark, many_orders).collect())
