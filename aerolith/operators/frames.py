"""Frames: neighbours, pairs, inlier credit, smoothing, and the selection of keyframes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (metres, seconds, sharpness) of each preset.
PRESETS = {"LOW": (1.5, 1.5, 45.0), "BALANCED": (0.8, 0.8, 55.0), "HIGH": (0.4, 0.4, 65.0)}


def sharpest_near(frames: DataFrame, reach: int) -> DataFrame:
    """frames with best_index and best_blur: the sharpest frame within reach rows, the earliest on a tie."""
    w = Window.partitionBy("job_id").orderBy("frame_index").rowsBetween(-reach, reach)
    best = F.max(F.struct("blur", -F.col("frame_index"))).over(w)
    return frames.withColumn("__best", best).withColumn("best_index", -F.col("__best.col2")).withColumn("best_blur", F.col("__best.blur")).drop("__best")


def pairs(frames: DataFrame, window: int) -> DataFrame:
    """job_id, a, b of all frames up to window + 1 places apart in their job; an equi-join on places."""
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("frame_index"))
    rows = frames.select("job_id", "frame_index", place.alias("place"))
    left = rows.select("job_id", F.col("frame_index").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(window + 1)), lambda k: F.col("place") + k)).alias("place"))
    return left.join(rows.withColumnRenamed("frame_index", "b"), ["job_id", "place"]).select("job_id", "a", "b").dropDuplicates()


def inlier_credit(matches: DataFrame) -> DataFrame:
    """Inliers of each frame from ordered matches (job_id, pos, a, b, inliers): all where it comes second, and its first
    match as the first frame if that is before any where it comes second."""
    second = matches.groupBy("job_id", F.col("b").alias("frame")).agg(F.sum("inliers").alias("credit"), F.min("pos").alias("from_b"))
    first = matches.groupBy("job_id", F.col("a").alias("frame")).agg(F.min(F.struct("pos", "inliers")).alias("f"))
    rows = second.join(first, ["job_id", "frame"], "full")
    own = F.when(F.col("from_b").isNull() | (F.col("f.pos") < F.col("from_b")), F.col("f.inliers")).otherwise(0)
    return rows.select("job_id", "frame", (F.coalesce("credit", F.lit(0)) + F.coalesce(own, F.lit(0))).alias("credit"))


def running_median(rows: DataFrame, value: str, reach: int = 2) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy("frame_index").rowsBetween(-reach, reach)
    return rows.withColumn("smooth", F.percentile(F.col(value), F.lit(0.5)).over(w))


def dominant(rows: DataFrame, value: str, order: str) -> DataFrame:
    """The commonest value of each job, the first seen on a tie."""
    counts = rows.groupBy("job_id", value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy("job_id").agg(F.max(F.struct("n", -F.col("first"), F.col(value).alias("v"))).alias("t")).select("job_id", F.col("t.v").alias(value), F.col("t.n").alias("n"))


def _haversine(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def _scan(job: pd.DataFrame, fps: float, limits: tuple[float, float, float]) -> Iterator[dict]:
    """Frames chosen one after the other: each choice is the reference of the next."""
    metres, seconds, sharp = limits
    job = job.sort_values("frame_index")
    blur, best, best_blur = job["blur"].to_numpy(), job["best_index"].to_numpy(), job["best_blur"].to_numpy()
    where = {i: (lat, lon) for i, lat, lon in zip(job["frame_index"], job["lat"], job["lon"], strict=True) if pd.notna(lat) and pd.notna(lon)}
    n, stride = len(job), max(1, round(0.1 * fps))
    last = int(best[0])
    spot = where[min(where)] if where else None
    yield {"frame_index": last, "blur": best_blur[0], "distance": 0.0, "elapsed": 0.0, "recovered": False}
    at = last + stride
    while at < n:
        moved = _haversine(spot, where[at]) if spot and at in where else None
        if at / fps - last / fps < seconds and (moved is None or moved < metres):
            at += stride
            continue
        recovered = bool(blur[at] < sharp and best_blur[at] > blur[at] and best[at] > last)
        chosen = int(best[at]) if recovered else at
        distance = _haversine(spot, where[chosen]) if spot and chosen in where else (moved or 0.0)
        yield {"frame_index": chosen, "blur": best_blur[at] if recovered else blur[at], "distance": distance, "elapsed": (chosen - last) / fps, "recovered": recovered}
        last, spot = chosen, where.get(chosen, spot)
        at = last + stride
    if n - 1 - last > int(fps * 0.3):
        yield {"frame_index": int(best[-1]), "blur": best_blur[-1], "distance": 0.5, "elapsed": (int(best[-1]) - last) / fps, "recovered": False}


def select_keyframes(frames: DataFrame, fps: float = 30.0, preset: str = "BALANCED", reach: int = 3) -> DataFrame:
    """Keyframes of each job from frames (job_id, frame_index from 0 without gaps, blur, lat, lon; the last two may be null).

    What doesn't depend on the choices is computed by windows; only the scan itself runs in Python, a job at a time.
    """
    for c in ("lat", "lon"):
        if c not in frames.columns:
            frames = frames.withColumn(c, F.lit(None).cast("double"))
    limits = PRESETS[preset]

    def run(job: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"job_id": job["job_id"].iloc[0], **row} for row in _scan(job, fps, limits)])

    ready = sharpest_near(frames, reach).select("job_id", F.col("frame_index").cast("long").alias("frame_index"), "blur", "lat", "lon", "best_index", "best_blur")
    return ready.groupBy("job_id").applyInPandas(run, "job_id long, frame_index long, blur double, distance double, elapsed double, recovered boolean")


def keyframe_summary(keyframes: DataFrame, frames: DataFrame) -> DataFrame:
    """Per job: keyframes, their share, mean interval without the first, and how many were recovered."""
    total = frames.groupBy("job_id").agg(F.count(F.lit(1)).alias("frames"))
    found = keyframes.groupBy("job_id").agg(F.count(F.lit(1)).alias("keyframes"), F.avg(F.when(F.col("elapsed") > 0, F.col("elapsed"))).alias("interval"), F.count_if("recovered").alias("recovered"))
    return total.join(found, "job_id").withColumn("percent", 100 * F.col("keyframes") / F.col("frames"))
