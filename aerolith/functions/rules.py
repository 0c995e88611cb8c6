"""Scores and rule cascades as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the input quality score.
QUALITY_WEIGHTS = {"blur": 0.28, "gps": 0.20, "texture": 0.15, "compression": 0.12, "exposure": 0.10, "shadow": 0.08, "illumination": 0.07}
#: Percent terms of the uncertainty of a measurement by confidence in depth and pose, and of the calibration.
DEPTH_TERM = {"HIGH": 1.0, "MEDIUM": 1.5, "LOW": 2.5}
POSE_TERM = {"HIGH": 0.5, "MEDIUM": 0.8, "LOW": 1.5}
CALIBRATION_TERM = 0.3
#: Ranks of roles.
ROLE_RANK = {"VIEWER": 1, "ANALYST": 2, "OPERATOR": 3, "PROJECT_MANAGER": 4, "ORG_ADMIN": 5}
#: Observation states.
UNKNOWN, OBSERVED, PARTIAL, INFERRED, DYNAMIC, LOW_CONFIDENCE = range(6)
TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def operating_height(relative: Column, barometric: Column, msl: Column, min_msl: Column) -> Column:
    """The first usable of relative and barometric height, else height over the lowest fix, 10 m at least."""
    return F.when(relative > 0, relative).when(barometric > 0, barometric).otherwise(F.greatest(F.lit(10.0), msl - min_msl))


def overlap_score(overlap: Column) -> Column:
    return F.when(overlap.between(65, 88), F.lit(100.0)).when(overlap > 88, F.greatest(F.lit(75.0), 100 - (overlap - 88) * 2)).otherwise(F.greatest(F.lit(0.0), overlap * 1.5))


def gps_composite(continuity: Column, smoothness: Column, overlap: Column) -> Column:
    return continuity * 0.5 + smoothness * 0.3 + overlap * 0.2


def input_quality(scores: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in QUALITY_WEIGHTS.items():
        total = total + scores[name] * weight
    return clip(total, 0.0, 100.0)


def quality_class(score: Column) -> Column:
    return F.when(score >= 80, "HIGH").when(score >= 60, "MODERATE").otherwise("LOW")


def observation_state(inferred: Column, confidence: Column, views: Column) -> Column:
    """The first rule that holds: inferred, low confidence, seen once, observed."""
    return F.when(inferred, INFERRED).when(confidence < 0.30, LOW_CONFIDENCE).when(views < 2, PARTIAL).otherwise(OBSERVED)


def positioning_mode(fixes: Column, frames: Column, rtk: Column, imu: Column) -> Column:
    return F.when(fixes == 0, "VISUAL_ONLY").when(fixes < 0.8 * frames, "GPS_DEGRADED").when(rtk, "RTK_PPK").when(imu, "GPS_IMU").otherwise("GPS_ONLY")


def gps_sigma(rtk: Column, hdop: Column, vdop: Column) -> tuple[Column, Column]:
    """Horizontal and vertical standard deviation of a fix; a dop of 0 counts as missing."""
    known = lambda c, default: F.coalesce(F.when(c != 0, c), F.lit(default))
    return F.when(rtk, 0.02).otherwise(2 * known(hdop, 2.0)), F.when(rtk, 0.04).otherwise(3 * known(vdop, 3.0))


def pose_confidence(inliers: Column, residual: Column) -> Column:
    """70 points for 1000 inliers, 30 for a residual of 5 m or less, 3 fewer for each metre more."""
    return F.least(F.lit(70.0), inliers / 1000 * 70) + F.greatest(F.lit(0.0), 30 - 3 * F.greatest(F.lit(0.0), residual - 5))


def uncertainty(depth: Column, pose: Column, inferred: Column) -> Column:
    """Percent error of a length: root of the sum of squares of its terms, and more where over 15 % is inferred."""
    look = lambda c, table: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(table["HIGH"]))
    a, b = look(depth, DEPTH_TERM), look(pose, POSE_TERM)
    return F.sqrt(a * a + b * b + CALIBRATION_TERM**2) + F.greatest(F.lit(0.0), inferred - 15) * 0.05


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1); 0 without area."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def codec_name(fourcc: Column) -> Column:
    """The four letters of a codec number, with the usual names for known ones."""
    text = F.lower(F.trim(F.concat(*[F.char(F.shiftright(fourcc, 8 * k).bitwiseAND(255)) for k in range(4)])))
    return F.when(text.isin("avc1", "h264", "x264"), "h264").when(text.isin("hvc1", "hev1", "hevc", "x265"), "hevc").when(text.isin("mp4v", "fmp4"), "mp4v").otherwise(text)


def safe_name(name: Column) -> Column:
    """A file name of letters, digits, dots, dashes and underscores."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def upload_parts(size: Column) -> Column:
    """Parts of 50 MB above 100 MB, else one."""
    return F.when(size > 100 * 1024 * 1024, F.ceil(size / (50 * 1024 * 1024))).otherwise(1).cast("int")


#: Extensions and largest sizes of files that may be uploaded, by kind.
UPLOADS = {"VIDEO": ((".mp4", ".mov", ".m4v", ".avi"), 50 * 1024**3), "TELEMETRY": ((".csv", ".json", ".srt", ".txt", ".gpx"), 500 * 1024**2)}


def upload_problem(name: Column, kind: Column, size: Column) -> Column:
    """Why an upload is refused, the first of ``kind``, ``name`` (empty or over 512 characters), ``extension``, ``empty`` and ``size``; null if it isn't."""
    extension = F.lower(F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"[^.](\.[^.]*)$", 1))
    known, allowed, most = F.lit(False), F.lit(False), F.lit(0)
    for k, (extensions, largest) in UPLOADS.items():
        known, allowed, most = known | (kind == k), allowed | ((kind == k) & extension.isin(*extensions)), F.when(kind == k, F.lit(largest)).otherwise(most)
    bad_name = name.isNull() | ~F.length(name).between(1, 512)
    return (
        F.when(~F.coalesce(known, F.lit(False)), "kind").when(bad_name, "name").when(~allowed, "extension").when(F.coalesce(size, F.lit(0)) <= 0, "empty").when(size > most, "size")
    )


def majority(a: Column, b: Column, c: Column) -> Column:
    """The value that two of three share, else the first."""
    return F.when(b == c, b).otherwise(a)


def texture_confidence(inferred: Column) -> Column:
    return F.when(inferred, 80).otherwise(240)
