"""Quality and accuracy reports as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolith.functions import rules

#: Least bitrates of a video in Mbit/s, bitrates below which its compression score is capped, and the caps a Mbit.
LEAST_BITRATE = {"4k": 25.0, "1080p": 8.0}
LOW_BITRATE = {"4k": (12.0, 4.0), "1080p": (4.0, 12.0)}
#: Targets of the horizontal, vertical and relative error, and limits of the classes of the first.
TARGETS = {"horizontal": 0.50, "vertical": 0.75, "measurement": 2.0}
MEDIUM_HORIZONTAL = 1.20


def is_4k(width: Column, height: Column) -> Column:
    return (width >= 3840) | (height >= 2160)


def is_1080p(width: Column, height: Column) -> Column:
    return (width >= 1920) | (height >= 1080)


def capped_compression(score: Column, width: Column, height: Column, bitrate: Column) -> Column:
    """A compression score, no more than a multiple of a very low bitrate; the rule of 1080p comes first, also for larger videos."""
    hd, uhd = LOW_BITRATE["1080p"], LOW_BITRATE["4k"]
    low = lambda limit: (bitrate > 0) & (bitrate < limit)
    return (
        F.when(is_1080p(width, height) & low(hd[0]), F.least(score, F.round(bitrate * hd[1], 2)))
        .when(is_4k(width, height) & low(uhd[0]), F.least(score, F.round(bitrate * uhd[1], 2)))
        .otherwise(score)
    )


def video_warnings(width: Column, height: Column, bitrate: Column, blur: Column, compression: Column, exposure: Column) -> Column:
    """Names of what speaks against a video, in a fixed order."""
    weak = F.when(is_4k(width, height) & (bitrate < LEAST_BITRATE["4k"]), "HIGH_VIDEO_COMPRESSION_4K").when(
        ~is_4k(width, height) & is_1080p(width, height) & (bitrate < LEAST_BITRATE["1080p"]), "HIGH_VIDEO_COMPRESSION_1080P"
    )
    return F.array_compact(
        F.array(
            F.when(~is_1080p(width, height), "RESOLUTION_BELOW_1080P"),
            weak,
            F.when(blur < 60, "HIGH_MOTION_BLUR"),
            F.when(compression < 60, "SEVERE_COMPRESSION_ARTIFACTS"),
            F.when(exposure < 60, "POOR_EXPOSURE_BALANCE"),
        )
    )


def illumination(luminance: Column) -> Column:
    """Aggregate over frames: 100 less 3.5 for each unit of deviation of their mean luminance."""
    return rules.clip(100 - 3.5 * F.coalesce(F.stddev_pop(luminance), F.lit(0.0)), 0.0, 100.0)


def accuracy_mode(rtk: Column, imu: Column, hdop: Column, satellites: Column, visual: Column) -> Column:
    """Positioning mode from the sensors: a dop over 4 or fewer than 6 satellites is degraded."""
    degraded = F.coalesce(hdop > 4, F.lit(False)) | F.coalesce(satellites < 6, F.lit(False))
    return F.when(visual, "VISUAL_ONLY").when(rtk, "RTK").when(degraded, "GPS_DEGRADED").when(imu, "GPS_IMU").otherwise("GPS_ONLY")


def scale_source(mode: Column, baro: Column) -> Column:
    """Where the scale of a mode comes from."""
    return F.when(mode.isin("VISUAL_ONLY", "RTK"), mode).when(baro & mode.isin("GPS_DEGRADED", "GPS_IMU"), "BAROMETRIC").otherwise("GPS_BASELINE")


def geolocation_class(horizontal: Column) -> Column:
    return F.when(horizontal <= TARGETS["horizontal"], "HIGH").when(horizontal <= MEDIUM_HORIZONTAL, "MEDIUM").otherwise("LOW")


def overall_quality(coverage: Column, horizontal: Column, vertical: Column, reprojection: Column, observed: Column, contamination: Column) -> Column:
    """0 to 100: 30 % coverage, 30 % accuracy, 20 % reprojection, 20 % visible surface, less 1.5 for each percent of contamination."""
    zero = F.lit(0.0)
    accuracy = 0.6 * F.greatest(zero, 100 - horizontal * 30) + 0.4 * F.greatest(zero, 100 - vertical / 1.5 * 20)
    visible = observed * 0.8 + coverage * 0.2
    total = 0.30 * coverage + 0.30 * accuracy + 0.20 * F.greatest(zero, 100 - reprojection * 25) + 0.20 * visible - contamination * 1.5
    return rules.clip(total, 0.0, 100.0)


def accuracy_warnings(horizontal: Column, vertical: Column, observed: Column, inferred: Column, mode: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(horizontal > TARGETS["horizontal"], "HORIZONTAL_RMSE"),
            F.when(vertical > TARGETS["vertical"], "VERTICAL_RMSE"),
            F.when((inferred > 15) | (observed < 70), "INFERRED_SURFACE"),
            F.when(mode.isin("GPS_DEGRADED", "VISUAL_ONLY"), "APPROXIMATE_POSITION"),
        )
    )


def expected_uncertainty(rtk: Column, baro: Column, sigma_h: Column, sigma_v: Column) -> tuple[Column, Column]:
    """Horizontal and vertical uncertainty in metres."""
    return F.when(rtk, 0.05).otherwise(sigma_h), F.when(rtk, 0.08).otherwise(sigma_v + F.when(baro, 0.15).otherwise(0.40))


def sums_to_hundred(*shares: Column) -> Column:
    return F.abs(sum(shares[1:], shares[0]) - 100) < 0.1
