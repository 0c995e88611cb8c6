"""Closed-form fixtures of the survey operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolith.functions import geodesy
from aerolith.operators import frames, meshes, points, telemetry, tracks
from aerolith.sinks import exports
from aerolith.sources import telemetry_files as tf
from aerolith.streaming import progress

FIX = "flight_id long, seq int, t double, lat double, lon double, alt double, rel double, baro double"


def flight(spark, rows):
    return telemetry.trajectory_quality(spark.createDataFrame(rows, FIX)).first()


def test_smooth_flight(spark):
    r = flight(spark, [(1, i, float(i), 37 + 4.5e-5 * i, -122.0, 100.0, 50.0, None) for i in range(10)])
    assert (r["continuity"], r["max_gap"], r["warnings"]) == (100.0, 1.0, []) and r["smoothness"] > 90 and r["overlap"] > 80


def test_gap_spike_and_too_few(spark):
    gap = flight(spark, [(1, i, t, 37.0, -122.0, 100.0, 50.0, None) for i, t in enumerate((0.0, 5.5, 6.5))])
    assert (gap["max_gap"], gap["continuity"]) == (5.5, 65.0) and "GPS_GAP_DETECTED" in gap["warnings"]
    spike = flight(spark, [(1, 0, 0.0, 37.0, -122.0, 100.0, 50.0, None), (1, 1, 1.0, 37.00054, -122.0, 100.0, 50.0, None)])
    assert spike["smoothness"] == pytest.approx(75) and "SPEED_SPIKE_DETECTED" in spike["warnings"]
    few = flight(spark, [(1, 0, 0.0, 37.0, -122.0, 100.0, 50.0, None)])
    assert (few["max_gap"], few["continuity"], few["warnings"]) == (999.0, 0.0, ["INSUFFICIENT_TELEMETRY_POINTS"])


def test_quality_classes(spark):
    trajectory = spark.createDataFrame([(1, 2, 98.0, 95.0, 92.0, [])], "flight_id long, fixes long, continuity double, smoothness double, overlap_score double, warnings array<string>")
    visual = dict(zip(("blur", "exposure", "texture", "shadow", "illumination", "compression"), map(F.lit, (92.0, 88.0, 85.0, 95.0, 90.0, 94.0)), strict=True))
    r = telemetry.quality_report(trajectory, visual).first()
    assert (round(r["gps"], 2), round(r["overall"], 2), r["quality"], r["warnings"]) == (95.9, 91.67, "HIGH", [])


def test_interpolation_turns_the_short_way(spark):
    fixes = spark.createDataFrame([(1, 0, 0.0, 350.0, 100.0), (1, 1, 2.0, 10.0, 104.0)], "flight_id long, seq int, t double, heading double, alt double")
    targets = spark.createDataFrame([(1, float(t)) for t in (-1, 0, 0.5, 1, 1.5, 2, 9)], "flight_id long, t double")
    got = {r["t"]: (round(r["heading"], 6) % 360, r["alt"]) for r in telemetry.interpolate(targets, fixes, ["alt"], "heading").collect()}
    assert got == {-1.0: (350.0, 100.0), 0.0: (350.0, 100.0), 0.5: (355.0, 101.0), 1.0: (0.0, 102.0), 1.5: (5.0, 103.0), 2.0: (10.0, 104.0), 9.0: (10.0, 104.0)}


def test_haversine_and_round_trip(spark):
    r = spark.range(1).select(geodesy.haversine(*map(F.lit, (37.0, -122.0, 38.0, -122.0))).alias("d"), *[c.alias(n) for c, n in zip(geodesy.geodetic(*geodesy.ecef(*map(F.lit, (52.2, 13.4, 80.0)))), "abc", strict=True)]).first()
    assert r["d"] == pytest.approx(6371000 * math.radians(1)) and (r["a"], r["b"], r["c"]) == pytest.approx((52.2, 13.4, 80.0), abs=1e-6)


def test_voxel_mean_and_single_views(spark):
    rows = [(1.001, 1.001, 5.001, 1, 90, 1), (1.041, 1.021, 5.021, 2, 30, 1), (3.05, 0.05, 0.05, 1, 40, 2), (4.05, 0.05, 0.05, 1, 85, 2)]
    got = points.fuse(spark.createDataFrame(rows, "x double, y double, z double, frame int, conf_pct int, cls int"), 0.1).collect()
    assert sorted((round(r["x"], 3), r["views"], r["cls"]) for r in got) == [(1.011, 2, 1), (4.05, 1, 2)]


def test_outliers_of_a_plane(spark):
    rows = [(i, float(i % 10) / 10, float(i // 10) / 10, 0.0) for i in range(100)] + [(100, 50.0, 50.0, 50.0), (101, -40.0, 0.0, 9.0)]
    cloud = spark.createDataFrame(rows, "id long, x double, y double, z double")
    assert points.radius_inliers(cloud, 0.5, 3).count() == 100
    assert {r["id"] for r in points.statistical_inliers(cloud, 10, 0.3, 2.0).collect()} >= set(range(100))


@pytest.mark.parametrize(("preset", "low", "high"), [("LOW", 32, 48), ("BALANCED", 60, 85), ("HIGH", 105, 140)])
def test_keyframe_density(spark, preset, low, high):
    rows = spark.range(1800).select(F.lit(1).cast("long").alias("job_id"), F.col("id").alias("frame_index"), F.lit(75.0).alias("blur"))
    assert low <= frames.select_keyframes(rows, 30.0, preset).count() <= high


def test_blurry_keyframe_is_replaced(spark):
    rows = spark.range(100).select(F.lit(1).cast("long").alias("job_id"), F.col("id").alias("frame_index"), F.when(F.col("id") == 24, 20.0).when(F.col("id") == 25, 90.0).otherwise(70.0).alias("blur"))
    chosen = {r["frame_index"] for r in frames.select_keyframes(rows).collect()}
    assert 24 not in chosen and 25 in chosen


def test_square_mesh(spark):
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 1.0, 0.0), (3, 0.0, 1.0, 0.0)], "vid long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 2, 3), (2, 0, 0, 1), (3, 0, 1, 2)], "fid long, i0 long, i1 long, i2 long")
    sound = meshes.sound_faces(faces, vertices)
    assert sorted(r["fid"] for r in sound.collect()) == [0, 1]
    assert {r["kind"] for r in meshes.edge_kinds(sound.select("fid", "i0", "i1", "i2")).collect()} == {"boundary", "manifold"}
    seen = meshes.select_views(faces.filter("fid < 2"), vertices, [(7, 0.5, 0.5, 3.0, 1.0), (8, 0.5, 0.5, -3.0, 9.0)]).collect()
    assert {r["view"] for r in seen} == {7} and all(r["angle"] < 10 for r in seen)


def test_tracker_keeps_an_object(spark):
    rows = [(1, 0, 0, [20.0, 20.0, 50.0, 50.0]), (1, 1, 0, [25.0, 20.0, 55.0, 50.0]), (1, 1, 1, [200.0, 200.0, 220.0, 220.0]), (1, 9, 0, [25.0, 20.0, 55.0, 50.0])]
    got = {(r["frame"], r["position"]): (r["track"], r["hits"]) for r in tracks.track(spark.createDataFrame(rows, "sequence long, frame long, position long, box array<double>")).collect()}
    assert got == {(0, 0): (1, 1), (1, 0): (1, 2), (1, 1): (2, 1), (9, 0): (1, 3)}


def test_subtitles(spark):
    new = "1\n00:00:00,000 --> 00:00:00,033\n[latitude: 37.774929] [longitude: -122.419416] [altitude: 125.4] [barometer: 45.2] [heading: 540.5] [rtk_flag: 1]\n\n2\n00:00:01,500 --> 00:00:02,000\n[latitude: 97.0] [longitude: 1.0]"
    old = "1\n00:00:01,000 --> 00:00:02,000\nGPS (37.77, -122.41, 12) H 12.5m H.S: -5.2m/s"
    got = {r["flight_id"]: r for r in tf.read_srt(spark.createDataFrame([(1, new), (2, old), (3, "junk"), (4, None)], "flight_id long, content string")).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["t"], got[1]["lat"], got[1]["baro"], got[1]["heading"], got[1]["has_rtk"]) == (0.0, 37.774929, 45.2, 180.5, True)
    assert (got[2]["t"], got[2]["lat"], got[2]["alt"], got[2]["baro"], got[2]["speed"], got[2]["has_rtk"]) == (1.0, 37.77, 12.5, None, 5.2, False)


def test_json_zero_is_a_value(spark):
    files = spark.createDataFrame([(1, '[{"latitude": 0.0, "longitude": 5.0}]'), (2, '{"points": [{"lat": 1, "lng": 2, "rtk_status": "FIXED"}]}')], "flight_id long, content string")
    assert {r["flight_id"]: r["has_rtk"] for r in tf.read_json(files).collect()} == {1: False, 2: True}
    assert [r["flight_id"] for r in tf.read_json(files, strict=True).collect()] == [2]
    with pytest.raises(ValueError):
        tf.csv_rows(spark.createDataFrame([("1",)], "alt string"))


def test_binary_files(spark):
    cloud = spark.createDataFrame([(0.0, 0.0, 0.0, 1, 0.5, 1, 255, 0, 1), (1.5, 2.0, 3.0, 2, 1.0, 5, 1, 2, 3)], "x double, y double, z double, cls int, conf double, state int, r int, g int, b int")
    data = exports.las_bytes(exports.las_columns(cloud).toPandas(), (0.0, 0.0, 0.0), (1.5, 2.0, 3.0))
    rows = np.frombuffer(data, exports.LAS_RECORD, offset=227)
    assert data[:4] == b"LASF" and len(rows) == 2 and sorted(rows["x"]) == [0, 1500] and set(rows["code"]) == {6, 11}
    tiff = exports.tiff_bytes(np.array([[250.75, np.nan]]), 0.0, 1.0, 1.0)
    assert tiff[:4] == b"II*\0" and np.float32(250.75).tobytes() in tiff and np.float32(-9999).tobytes() in tiff
    ply = exports.ply_bytes(pd.DataFrame({c: [1] for c in exports.PLY_RECORD.names}))
    assert ply.startswith(b"ply\n") and ply.endswith(np.ones(1, np.uint8).tobytes())


def test_stream_of_job_states(spark, tmp_path):
    rows = [(1, "VALIDATING", 5.0, 1), (1, "QUEUED", 0.0, 2), (1, "COMPLETED", 100.0, 3), (1, "FUSING", 50.0, 4), (2, "CANCELLED", 0.0, 1)]
    spark.createDataFrame(rows, "job_id long, stage string, progress double, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("job_id long, stage string, progress double, ts timestamp").parquet(str(tmp_path / "in"))
    q = progress.job_states(events).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["job_id"], r["state"], r["refused"]) for r in spark.table("states").collect()} == {(1, "COMPLETED", 2), (2, "CANCELLED", 0)}
    q = events.writeStream.foreachBatch(progress.upsert_latest(str(tmp_path / "latest"))).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert progress.read_latest(spark, str(tmp_path / "latest")).filter("job_id = 1").first()["stage"] == "FUSING"


def test_event_normalisation(spark):
    raw = spark.createDataFrame([('{"job_id": "a", "stage": "POSE", "gpu_stats": {"utilization": 88.5}, "total_frames": 1000}',), ("not json",)], "raw string")
    got = [r["e"] for r in raw.select(progress.normalise(F.col("raw")).alias("e")).collect()]
    assert (got[0]["gpu_utilization"], got[0]["frames_total"], got[0]["raw"]) == (88.5, 1000, None) and got[1]["raw"] == "not json"


def test_local_planes_and_identity(spark):
    from aerolith.operators import alignment

    flat = spark.createDataFrame([(1, float(i % 5), float(i // 5), 5.0) for i in range(25)], "id long, x double, y double, z double")
    r = alignment.local_planes(flat, "id").first()
    assert abs(r["nz"]) == pytest.approx(1) and r["curvature"] == pytest.approx(0)
    few = spark.createDataFrame([(0.0,) * 6], ", ".join(f"{s}{c} double" for s in "st" for c in "xyz"))
    assert alignment.umeyama(few)[0] == 1.0


def test_descriptors_in_blocks_of_any_size(spark):
    from aerolith.operators import alignment

    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(90, 4)), 1)
    v[10] = v[11] = v[12]
    rows = [(i % 3 if i < 80 else 7, i, v[i].tolist()) for i in range(90)] + [(9, 500, [1.0] * 4), (None, 501, [1.0] * 4), (1, None, [1.0] * 4), (1, 502, None)]
    table = spark.createDataFrame(rows, "label int, id long, v array<double>")
    want = {}
    for label, a, p in rows[:90]:
        near = sorted((float(np.sqrt(((np.array(p) - np.array(q)) ** 2).sum())), b) for other, b, q in rows[:90] if other == label and b != a)
        if near[0][0] < 0.8 * near[1][0]:
            want[a] = near[0]
    for block in (1, 7, 1024):
        got = {r["a"]: (r["d"], r["b"]) for r in alignment.ratio_matches(table, table, "label", 0.8, block).collect()}
        assert set(got) == set(want) and all(got[a][1] == want[a][1] and abs(got[a][0] - want[a][0]) < 1e-9 for a in got)
