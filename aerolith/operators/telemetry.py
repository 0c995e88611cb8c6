"""Flight telemetry: summaries, trajectory quality, heading unwrap and interpolation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import geodesy, rules
from aerolith.operators.asof import asof_join

MAX_SPEED = 30.0
NORMAL_GAP, LONG_GAP = 2.0, 5.0
FIELD_OF_VIEW = 84.0


def track_summary(fixes: DataFrame) -> DataFrame:
    """Per flight: whether any fix has RTK or a barometer, duration and rate."""
    span = F.max("t") - F.min("t")
    return fixes.groupBy("flight_id").agg(
        F.coalesce(F.bool_or("has_rtk"), F.lit(False)).alias("has_rtk"),
        F.count("baro").__gt__(0).alias("has_baro"),
        span.alias("duration"),
        F.when(span > 0, F.count(F.lit(1)) / F.greatest(F.lit(1.0), span)).otherwise(F.lit(1.0)).alias("rate"),
    )


def trajectory_quality(fixes: DataFrame) -> DataFrame:
    """A row of metrics and scores for each flight; one shuffle on flight_id.

    A flight with fewer than two fixes scores 0 with a gap of 999.
    """
    order = Window.partitionBy("flight_id").orderBy("t", "seq")
    rows = fixes.select(
        "flight_id",
        (F.col("t") - F.lag("t").over(order)).alias("dt"),
        geodesy.haversine(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon")).alias("dist"),
        rules.operating_height(F.col("rel"), F.col("baro"), F.col("alt"), F.min("alt").over(Window.partitionBy("flight_id"))).alias("height"),
    )
    step = F.col("dt") > 0
    speed = F.when(step, F.col("dist") / F.col("dt"))
    found = rows.groupBy("flight_id").agg(
        F.count(F.lit(1)).alias("fixes"),
        F.coalesce(F.max(F.when(step, F.col("dt"))), F.lit(0.0)).alias("max_gap"),
        F.coalesce(F.max(speed), F.lit(0.0)).alias("max_speed"),
        F.coalesce(F.avg(speed), F.lit(0.0)).alias("avg_speed"),
        F.coalesce(F.stddev_pop(speed), F.lit(0.0)).alias("speed_deviation"),
        F.count_if(speed > MAX_SPEED).alias("spikes"),
        F.coalesce(F.avg(F.when(step, F.col("dist"))), F.lit(0.0)).alias("baseline"),
        F.coalesce(F.avg(F.when(step, F.col("height"))), F.lit(50.0)).alias("height"),
        F.sum(F.when(F.col("dt") > LONG_GAP, 35).when(F.col("dt") > NORMAL_GAP, 15).otherwise(0)).alias("penalty"),
    )
    width = F.col("height") * (2 * math.tan(math.radians(FIELD_OF_VIEW / 2)))
    found = found.withColumn("overlap", F.when(width > 0, rules.clip((1 - F.col("baseline") / width) * 100, 0.0, 100.0)).otherwise(F.lit(70.0)))
    few = F.col("fixes") < 2
    scored = lambda c: F.when(few, F.lit(0.0)).otherwise(c)
    return found.select(
        "flight_id",
        "fixes",
        F.when(few, F.lit(999.0)).otherwise(F.col("max_gap")).alias("max_gap"),
        "max_speed",
        "avg_speed",
        scored(F.col("baseline")).alias("baseline"),
        scored(F.col("height")).alias("height"),
        scored(F.col("overlap")).alias("overlap"),
        scored(rules.clip(100.0 - F.col("penalty"), 0.0, 100.0)).alias("continuity"),
        scored(rules.clip(100 - 3 * F.col("speed_deviation") - 25 * F.col("spikes"), 0.0, 100.0)).alias("smoothness"),
        scored(rules.overlap_score(F.col("overlap"))).alias("overlap_score"),
        F.array_compact(
            F.array(
                F.when(few, "INSUFFICIENT_TELEMETRY_POINTS"),
                F.when(~few & (F.col("max_gap") > NORMAL_GAP), "GPS_GAP_DETECTED"),
                F.when(~few & (F.col("spikes") > 0), "SPEED_SPIKE_DETECTED"),
                F.when(~few & (F.col("overlap") < 55), "LOW_VIEW_OVERLAP"),
            )
        ).alias("warnings"),
    )


def quality_report(trajectory: DataFrame, visual: dict[str, Column]) -> DataFrame:
    """The input quality score of each flight from its trajectory and visual scores (a column for each)."""
    gps = rules.gps_composite(F.col("continuity"), F.col("smoothness"), F.col("overlap_score"))
    rows = trajectory.withColumn("gps", gps).withColumn("overall", rules.input_quality({**visual, "gps": F.col("gps")}))
    low = [("blur", 60, "HIGH_MOTION_BLUR"), ("compression", 50, "HIGH_VIDEO_COMPRESSION"), ("shadow", 40, "HEAVY_SHADOWS"), ("gps", 50, "POOR_GPS"), ("texture", 40, "LOW_TEXTURE"), ("exposure", 50, "POOR_EXPOSURE")]
    scores = {**visual, "gps": F.col("gps")}
    more = F.array_compact(F.array(*[F.when(scores[name] < limit, text) for name, limit, text in low]))
    return rows.select("flight_id", "fixes", "overall", rules.quality_class(F.col("overall")).alias("quality"), (F.col("overall") >= 40).alias("reconstructible"), "gps", F.concat("warnings", more).alias("warnings"))


def unwrap(fixes: DataFrame, angle: str, order: list[str]) -> DataFrame:
    """fixes with ``unwrapped``: the angle without jumps of over half a turn between consecutive fixes."""
    w = Window.partitionBy("flight_id").orderBy(*order)
    jump = F.col(angle) - F.lag(angle).over(w)
    turn = F.when(F.abs(jump) <= 180, F.lit(0.0)).otherwise(-360.0 * F.floor((jump + 180) / 360))
    return fixes.withColumn("__turn", F.coalesce(turn, F.lit(0.0))).withColumn("unwrapped", F.col(angle) + F.sum("__turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__turn")


def interpolate(targets: DataFrame, fixes: DataFrame, values: list[str], heading: str | None = None) -> DataFrame:
    """targets (flight_id, t, ...) with linearly interpolated values; the ends are held; headings turn the short way."""
    if heading:
        fixes = unwrap(fixes, heading, ["t", "seq"]).withColumn(heading, F.col("unwrapped")).drop("unwrapped")
        values = [*values, heading]
    rows = asof_join(targets, fixes.select("flight_id", "t", "seq", *values), ["flight_id"], "t", "seq", ("backward", "forward"))
    before, after = F.col("prev"), F.col("next")
    part = F.when(after["t"] > before["t"], (F.col("t") - before["t"]) / (after["t"] - before["t"])).otherwise(F.lit(0.0))
    columns = []
    for name in values:
        value = F.when(before.isNull(), after[name]).when(after.isNull(), before[name]).otherwise(before[name] + part * (after[name] - before[name]))
        columns.append((F.pmod(value, F.lit(360.0)) if name == heading else value).alias(name))
    return rows.select(*targets.columns, *columns)
