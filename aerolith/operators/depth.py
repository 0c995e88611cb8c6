"""Metric scale of depth maps, as tables of pixels (job, frame, v, u, depth) and of poses (job, frame, e, n, u, agl)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of a scale, points that a sparse fit needs, tolerance and height of the barometric test.
SCALE_BOUNDS = (0.01, 1000.0)
LEAST_POINTS = 5
BARO_TOLERANCE, TYPICAL_HEIGHT = 0.05, 50.0
#: The plausible depths of a raw map, of the patches of both estimates, and of a calibrated map.
PLAUSIBLE, BASELINE_RANGE, NADIR_RANGE, CALIBRATED_RANGE, CEILING = (0.1, 300.0), (0.1, 250.0), (0.1, 300.0), (0.3, 300.0), 500.0
#: Sources of a scale, best first.
SPARSE, BASELINE, BAROMETRIC, PROPAGATED = "SPARSE_3D", "GPS_BASELINE", "BAROMETRIC", "MEDIAN_PROPAGATION"


def _within(c: Column, bounds: tuple[float, float]) -> Column:
    return c.between(*bounds)


def _bounded(scale: Column) -> Column:
    return F.when(_within(scale, SCALE_BOUNDS), scale)


def depth_stats(pixels: DataFrame, bounds: tuple[float, float] = PLAUSIBLE) -> DataFrame:
    """job, frame, valid, low, high, middle over the plausible depths of each frame; zeros where there is none."""
    ok = F.when(_within(F.col("depth"), bounds), F.col("depth"))
    zero = F.lit(0.0)
    return pixels.groupBy("job", "frame").agg(
        F.count(ok).alias("valid"), F.coalesce(F.min(ok), zero).alias("low"), F.coalesce(F.max(ok), zero).alias("high"), F.coalesce(F.median(ok), zero).alias("middle")
    )


def _patch_median(pixels: DataFrame, half: tuple[int, int], size: tuple[int, int], bounds: tuple[float, float], least: int, name: str) -> DataFrame:
    """job, frame and the median depth of the middle patch, null with fewer than ``least`` plausible pixels."""
    inside = F.lit(True)
    for axis, n, h in zip(("v", "u"), size, half, strict=True):
        inside = inside & F.col(axis).between(max(0, n // 2 - h), n // 2 + h - 1)
    found = pixels.filter(inside & _within(F.col("depth"), bounds)).groupBy("job", "frame").agg(F.count(F.lit(1)).alias("n"), F.median("depth").alias("m"))
    return found.select("job", "frame", F.when(F.col("n") >= least, F.col("m")).alias(name))


def baseline_scale(pixels: DataFrame, poses: DataFrame, size: tuple[int, int]) -> DataFrame:
    """poses with scale_gps: the way from the frame before over the change of the depth in the middle; null where either is too small."""
    middle = _patch_median(pixels, tuple(max(1, n // 8) for n in size), size, BASELINE_RANGE, 11, "middle")
    rows = poses.join(middle, ["job", "frame"], "left").withColumn("middle", F.coalesce("middle", F.lit(0.0)))
    w = Window.partitionBy("job").orderBy("frame")
    way = F.sqrt(sum((F.pow(F.col(c) - F.lag(c).over(w), 2) for c in ("n", "up")), F.pow(F.col("e") - F.lag("e").over(w), 2)))
    change = F.abs(F.col("middle") - F.lag("middle").over(w))
    rows = rows.withColumns({"way": way, "change": change})
    return rows.withColumn("scale_gps", F.when((F.col("way") >= 0.1) & (F.col("change") >= 1e-3), _bounded(F.col("way") / F.col("change"))))


def barometric_scale(pixels: DataFrame, poses: DataFrame, size: tuple[int, int]) -> DataFrame:
    """poses with scale_baro: the height above ground over the depth at the nadir; null below 1 m or without ten plausible pixels."""
    half = max(5, min(size) // 20)
    nadir = _patch_median(pixels, (half, half), size, NADIR_RANGE, 10, "nadir")
    rows = poses.join(nadir, ["job", "frame"], "left")
    return rows.withColumn("scale_baro", F.when((F.col("agl") >= 1) & (F.col("nadir") >= 1e-3), _bounded(F.col("agl") / F.col("nadir"))))


def sparse_scale(points: DataFrame) -> DataFrame:
    """job, frame, scale_sparse, n, residual from seen points (ax, ay, az at unit scale; bx, by, bz in the world; depth).

    The scale minimises the sum of |s * a - b|^2, which is sum(a.b) / sum(a.a); a frame needs LEAST_POINTS of them.
    """
    points = points.filter(F.col("depth") >= 0.01)
    dot = lambda p, q: sum((F.col(f"{p}{c}") * F.col(f"{q}{c}") for c in "yz"), F.col(f"{p}x") * F.col(f"{q}x"))
    sums = points.groupBy("job", "frame").agg(F.count(F.lit(1)).alias("n"), F.sum(dot("a", "b")).alias("ab"), F.sum(dot("a", "a")).alias("aa"))
    fits = sums.filter((F.col("n") >= LEAST_POINTS) & (F.col("aa") >= 1e-9)).select("job", "frame", "n", _bounded(F.col("ab") / F.col("aa")).alias("scale_sparse"))
    fits = fits.filter("scale_sparse is not null")
    gap = F.sqrt(sum((F.pow(F.col("scale_sparse") * F.col(f"a{c}") - F.col(f"b{c}"), 2) for c in "yz"), F.pow(F.col("scale_sparse") * F.col("ax") - F.col("bx"), 2)))
    return points.join(fits.drop("n"), ["job", "frame"]).groupBy("job", "frame").agg(F.first("scale_sparse").alias("scale_sparse"), F.count(F.lit(1)).alias("n"), F.avg(gap).alias("residual"))


def chosen_scale(frames: DataFrame) -> DataFrame:
    """frames with raw, mode, points and residual: the first of the sparse, baseline and barometric scale that there is, else 1."""
    sparse, gps, baro = (F.col(c).isNotNull() for c in ("scale_sparse", "scale_gps", "scale_baro"))
    pick = lambda a, b, c, d: F.when(sparse, a).when(gps, b).when(baro, c).otherwise(d)
    return frames.withColumns({
        "raw": F.coalesce("scale_sparse", "scale_gps", "scale_baro", F.lit(1.0)),
        "mode": pick(F.lit(SPARSE), F.lit(BASELINE), F.lit(BAROMETRIC), F.lit(PROPAGATED)),
        "points": pick(F.col("n_sparse"), F.lit(2), F.lit(1), F.lit(0)).cast("long"),
        "residual": F.when(sparse, F.col("residual_sparse")).otherwise(0.0),
    })


def aligned(frames: DataFrame) -> DataFrame:
    """frames of ``chosen_scale`` with smooth, the running median of five raw scales of a job."""
    w = Window.partitionBy("job").orderBy("frame").rowsBetween(-2, 2)
    near = F.array_sort(F.collect_list("raw").over(w))
    rows = frames.withColumn("near", near).withColumn("half", F.size("near") / 2)
    low, high = F.get("near", F.ceil("half").cast("int") - 1), F.get("near", F.floor("half").cast("int"))
    return rows.withColumn("smooth", (low + high) / 2).drop("near", "half")


def alignment_report(frames: DataFrame) -> DataFrame:
    """job, frames, scale, residual, mode (the first seen of the commonest), baro_ok (null if no scale came from GPS or a barometer)."""
    commonest = frames.groupBy("job", "mode").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("f")).groupBy("job").agg(F.max(F.struct("n", -F.col("f"), "mode")).alias("m"))
    measured = F.bool_or(F.col("mode").isin(BASELINE, BAROMETRIC))
    ok = F.when(measured, F.avg("residual") / TYPICAL_HEIGHT <= BARO_TOLERANCE)
    found = frames.groupBy("job").agg(F.count(F.lit(1)).alias("frames"), F.median("smooth").alias("scale"), F.avg("residual").alias("residual"), ok.alias("baro_ok"))
    return found.join(commonest, "job").select("job", "frames", "scale", "residual", F.col("m.mode").alias("mode"), "baro_ok")


def calibrated(pixels: DataFrame, scales: DataFrame) -> DataFrame:
    """pixels with their depth in metres (0 to CEILING) and whether it is valid, by the smooth scale of their frame."""
    metres = F.greatest(F.lit(0.0), F.least(F.lit(CEILING), F.col("depth") * F.col("smooth")))
    rows = pixels.join(scales.select("job", "frame", "smooth"), ["job", "frame"]).withColumn("depth", metres)
    return rows.withColumn("valid", _within(F.col("depth"), CALIBRATED_RANGE)).drop("smooth")


def fused_confidence(parts: list[Column]) -> Column:
    """The mean of several scores of 0 to 255, clipped and cut to a whole number."""
    return F.greatest(F.lit(0), F.least(F.lit(255), (sum(parts[1:], parts[0]) / len(parts)).cast("int")))
