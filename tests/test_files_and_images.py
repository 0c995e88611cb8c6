"""Point files written, retried and read back; stencils and warps against plain numpy; upload rules."""

import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aerolith.functions import rules
from aerolith.operators import images
from aerolith.sources import point_files


@pytest.fixture
def cloud(spark):
    spark.dataSource.register(point_files.PointFiles)
    n = F.col("id")
    coordinates = [(n * 1.25 - 300).alias("x"), ((n % 7) * 0.5).alias("y"), (-n / 8).alias("z"), *[F.lit(v).cast("float").alias(c) for c, v in (("nx", 0.0), ("ny", 0.0), ("nz", 1.0))]]
    return spark.range(0, 1000, 1, 3).select(*coordinates, ((n % 101) / 100).alias("conf"), (n % 11).cast("int").alias("cls"), (n % 6).cast("int").alias("state"), *[(n % 256).cast("int").alias(c) for c in "rgb"], n.alias("extra"))


def stored(path):
    return sorted(f for f in os.listdir(path) if f.startswith("part-"))


@pytest.mark.parametrize("kind", ["las", "ply"])
def test_points_come_back(spark, cloud, tmp_path, kind):
    path = str(tmp_path / kind)
    write = lambda df, mode: df.write.format("points").option("kind", kind).option("points", 150).mode(mode).save(f"file://{path}")
    write(cloud, "append")
    named = json.load(open(f"{path}/_manifest.json"))["files"]
    assert len(named) == 9 and sum(f["points"] for f in named) == 1000 and sorted(f["name"] for f in named) == stored(path)
    assert all(os.path.getsize(f"{path}/{f['name']}") == f["bytes"] for f in named)
    read = spark.read.format("points").option("records", 64).load(f"file://{path}")
    assert read.rdd.getNumPartitions() == sum(-(-f["points"] // 64) for f in named)
    keys = ["x", "y", "z", "state", "r"]
    got = sorted((round(r["x"], 3), round(r["y"], 3), round(r["z"], 3), r["state"], r["r"]) for r in read.select(keys).collect())
    assert got == sorted((round(r["x"], 3), round(r["y"], 3), round(r["z"], 3), r["state"], r["r"]) for r in cloud.select(keys).collect())
    write(cloud.limit(10), "append")
    assert spark.read.format("points").load(f"file://{path}").count() == 1010
    write(cloud.limit(20), "overwrite")
    assert spark.read.format("points").load(f"file://{path}").count() == 20 and sum(f["points"] for f in json.load(open(f"{path}/_manifest.json"))["files"]) == 20
    assert len(stored(path)) == len(json.load(open(f"{path}/_manifest.json"))["files"])


def test_a_failed_write_leaves_nothing(spark, cloud, tmp_path):
    path = str(tmp_path / "c")
    cloud.limit(50).write.format("points").mode("append").save(path)
    before = stored(path)
    bad = cloud.withColumn("conf", F.when(F.col("extra") < 990, F.col("conf")))
    with pytest.raises(Exception, match="conf is null"):
        bad.write.format("points").option("points", 100).mode("append").save(path)
    assert stored(path) == before and spark.read.format("points").load(path).count() == 50
    with pytest.raises(Exception, match="needs the columns"):
        cloud.drop("cls").write.format("points").mode("append").save(path)
    with pytest.raises(Exception, match="holds las files"):
        cloud.write.format("points").option("kind", "ply").mode("append").save(path)
    assert stored(path) == before


def test_a_retried_task_counts_once(tmp_path):
    writer = point_files.PointWriter(str(tmp_path), "las", list(point_files.WRITTEN["las"]), False, 100)
    batch = pa.record_batch({c: pa.array(np.arange(30) % 5 + (0.5 if c in "xyz" else 0)) for c in point_files.WRITTEN["las"]})
    writer.write(iter([batch]))  # its executor is lost after the file was written
    again = writer.write(iter([batch]))
    assert len(stored(tmp_path)) == 2
    writer.commit([again, None])
    assert stored(tmp_path) == [f["name"] for f in point_files.manifest(str(tmp_path))["files"]] and len(stored(tmp_path)) == 1
    empty = point_files.PointWriter(str(tmp_path / "e"), "las", list(point_files.WRITTEN["las"]), False, 100)
    empty.commit([empty.write(iter([]))])
    assert point_files.manifest(str(tmp_path / "e"))["files"] == []


def reflected(a):
    return np.pad(a, 1, mode="reflect")


@pytest.mark.parametrize(("size", "tile"), [((9, 13), 4), ((8, 8), 8), ((2, 5), 3), ((7, 6), 256)])
def test_stencils_on_tiles(spark, size, tile):
    rng = np.random.default_rng(2)
    grid = rng.integers(0, 256, (2, *size)).astype(float)
    grid[:, 0, 0] = 0
    rows = [(f, v, u, float(grid[f, v, u])) for f in range(2) for v in range(size[0]) for u in range(size[1]) if (v, u) != (0, 0)]
    rows += [(0, 1, 1, float(grid[0, 1, 1] - 5)), (0, size[0], 0, 9.0), (1, -1, 0, 9.0), (None, 0, 0, 9.0), (1, 0, 0, None)]
    pixels = spark.createDataFrame(rows, "frame long, v int, u int, value double")
    found = images.visual_scores(pixels, size, tile).collect()
    assert len(found) == 2
    for r in found:
        a = reflected(grid[r["frame"]])
        gx, gy = images.sobel(a)
        lap = a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:] - 4 * a[1:-1, 1:-1]
        grey = grid[r["frame"]]
        clip = lambda x: max(0.0, min(100.0, x))
        assert r["blur"] == pytest.approx(clip(lap.var() / 3), abs=0.011) and r["texture"] == pytest.approx(clip(np.sqrt(gx**2 + gy**2).mean() / 25 * 100), abs=0.011)
        assert r["exposure"] == pytest.approx(clip((1 - ((grey < 30).mean() + (grey > 225).mean()) * 1.6) * 100), abs=0.011)
        dark = round((grey < max(20.0, np.median(grey) * 0.35)).mean() * 100, 2)
        assert r["coverage"] == pytest.approx(dark, abs=0.011) and r["light"] == pytest.approx(grey.mean())
    scores = images.depth_scores(pixels, size, tile).collect()
    assert len(scores) == 2 * size[0] * size[1]
    for r in scores:
        d = grid[r["frame"]]
        gx, gy = images.sobel(reflected(d))
        steep = min(5.0, float(np.hypot(gx, gy)[r["v"], r["u"]]))
        assert abs(r["gradient"] - int((1 - steep / 5) * 255)) <= 1
        x = d[r["v"], r["u"]]
        assert r["plausible"] == (80 if x < 0.6 else 30 if x > 225 else 220)


def test_a_still_camera_sees_the_same_and_a_shift_is_found(spark):
    size, turn = (6, 8), [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    grey = np.random.default_rng(1).integers(0, 256, size)
    rows = [(f, v, u, int(grey[v, (u + f) % 8]), 2.0) for f in (0, 1) for v in range(6) for u in range(8)]
    rows += [(2, v, u, int(grey[v, (u + 1) % 8]), 2.0) for v in range(6) for u in range(8)]
    pixels = spark.createDataFrame(rows, "frame long, v int, u int, grey long, depth double")
    poses = spark.createDataFrame([(0, 1, turn, [-0.05, 0.0, 0.0]), (1, 2, turn, [0.0, 0.0, 0.0])], "frame long, next long, r array<double>, t array<double>")
    found = images.reprojection_scores(pixels, poses, (40.0, 40.0, 4.0, 3.0), size).collect()
    assert len(found) == 96
    assert all(r["score"] >= 254 for r in found if r["frame"] == 1 or r["u"] > 0)  # frame 1 shows what is one pixel to the right
    behind = images.reprojection_scores(pixels.withColumn("depth", F.lit(-1.0)), poses, (40.0, 40.0, 4.0, 3.0), size)
    assert all(r["score"] == max(0, int((1 - int(grey[r["v"], (r["u"] + r["frame"]) % 8]) / 30) * 255)) for r in behind.collect())


def test_uploads(spark):
    rows = [("a.MP4", "VIDEO", 1), ("a.csv", "VIDEO", 1), ("a.gpx", "TELEMETRY", 500 * 1024**2), ("a.gpx", "TELEMETRY", 500 * 1024**2 + 1), ("a.mp4", "VIDEO", 50 * 1024**3 + 1), ("a.mp4", "AUDIO", 1), ("", "VIDEO", 1), ("a.mp4", "VIDEO", 0)]
    rows += [("x" * 513, "VIDEO", 1), (None, "VIDEO", 1), ("a", None, 1), ("tar.d/noext", "VIDEO", 1), (".mp4", "VIDEO", 1), ("a.b.mov", "VIDEO", None)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, kind string, size long")
    got = [r["p"] for r in table.orderBy("i").select(rules.upload_problem(F.col("name"), F.col("kind"), F.col("size")).alias("p")).collect()]
    assert got == [None, "extension", None, "size", "size", "kind", "name", "empty", "name", "name", "kind", "extension", "extension", "empty"]
