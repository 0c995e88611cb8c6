"""Rotations, cameras and the confidence of poses as Column expressions; matrices are nested lists of Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Horizontal field of view of a camera without calibration, target of the reprojection error in pixels.
DEFAULT_FOV = 70.0
REPROJECTION_TARGET = 1.5

Matrix = list[list[Column]]


def product(a: Matrix, b: Matrix) -> Matrix:
    return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]


def transposed(a: Matrix) -> Matrix:
    return [[a[j][i] for j in range(3)] for i in range(3)]


def euler_zyx(yaw: Column, pitch: Column, roll: Column) -> Matrix:
    """The rotation about z, then the turned y, then the turned x, from degrees: Rz(yaw) Ry(pitch) Rx(roll)."""
    (cy, sy), (cp, sp), (cr, sr) = ((F.cos(F.radians(a)), F.sin(F.radians(a))) for a in (yaw, pitch, roll))
    return [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]


def quaternion(r: Matrix) -> list[Column]:
    """x, y, z, w of a rotation, by the largest of the four squares."""
    t = r[0][0] + r[1][1] + r[2][2]
    squares = [1 + 2 * r[0][0] - t, 1 + 2 * r[1][1] - t, 1 + 2 * r[2][2] - t, 1 + t]
    best = F.greatest(*squares)
    off = {(0, 1): r[1][0] + r[0][1], (0, 2): r[2][0] + r[0][2], (1, 2): r[2][1] + r[1][2], (0, 3): r[2][1] - r[1][2], (1, 3): r[0][2] - r[2][0], (2, 3): r[1][0] - r[0][1]}
    half = F.sqrt(best)
    out = []
    for k in range(4):
        value = None
        for lead in range(4):
            term = best if k == lead else off[min(k, lead), max(k, lead)]
            value = F.when(squares[lead] == best, term) if value is None else value.when(squares[lead] == best, term)
        out.append(value / half / 2)
    return out


def rotation_vector(r: Matrix) -> list[Column]:
    """Axis times angle (below 180 degrees)."""
    x, y, z, w = quaternion(r)
    norm = F.sqrt(x * x + y * y + z * z)
    factor = F.when(norm < 1e-12, F.lit(2.0)).otherwise(2 * F.atan2(norm, F.abs(w)) / norm) * F.when(w < 0, -1.0).otherwise(1.0)
    return [x * factor, y * factor, z * factor]


def from_rotation_vector(v: list[Column]) -> Matrix:
    """The matrix of an axis times an angle, by Rodrigues' formula."""
    angle = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    safe = F.when(angle < 1e-12, F.lit(1.0)).otherwise(angle)
    x, y, z = (c / safe for c in v)
    s, c = F.sin(angle), F.cos(angle)
    k = 1 - c
    return [[c + k * x * x, k * x * y - s * z, k * x * z + s * y], [k * x * y + s * z, c + k * y * y, k * y * z - s * x], [k * x * z - s * y, k * y * z + s * x, c + k * z * z]]


def intrinsics(width: Column, height: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    """fx, fy, cx, cy as given; without fx those of a 70 degree view with square pixels."""
    focal = width / 2 / math.tan(math.radians(DEFAULT_FOV) / 2)
    known = fx.isNotNull()
    return [F.when(known, given).otherwise(default) for given, default in ((fx, focal), (fy, focal), (cx, width / 2), (cy, height / 2))]


def world_to_camera(rotation: Matrix, centre: list[Column]) -> tuple[Matrix, list[Column]]:
    """Rotation and shift into the camera from its rotation into the world and its centre."""
    r = transposed(rotation)
    return r, [-(r[i][0] * centre[0] + r[i][1] * centre[1] + r[i][2] * centre[2]) for i in range(3)]


def projected(r: Matrix, t: list[Column], k: list[Column], p: list[Column]) -> tuple[Column, Column, Column]:
    """Pixel and depth of a world point."""
    x, y, z = (r[i][0] * p[0] + r[i][1] * p[1] + r[i][2] * p[2] + t[i] for i in range(3))
    deep = F.when(z != 0, z)  # a point in the plane of the camera has no pixel
    return k[0] * x / deep + k[2], k[1] * y / deep + k[3], z


def reprojection_rmse(u: Column, v: Column, z: Column, seen_u: Column, seen_v: Column) -> Column:
    """Aggregate: root mean square of the distances in pixels, 0 with fewer than four points before the camera."""
    ahead = z > 1e-6
    return F.when(F.count_if(ahead) >= 4, F.sqrt(F.avg(F.when(ahead, F.pow(u - seen_u, 2) + F.pow(v - seen_v, 2))))).otherwise(0.0)


def sigma_confidence(sigma_e: Column, sigma_n: Column, rtk: Column, gps: Column) -> Column:
    """0 to 100: 10 less for each 0.02 m with RTK, 20 less for each 2 m with GPS, else 70 and 10 less for each metre."""
    h = F.sqrt(sigma_e * sigma_e + sigma_n * sigma_n) / math.sqrt(2)
    score = F.when(rtk, 100 - h / 0.02 * 10).when(gps, 100 - h / 2 * 20).otherwise(70 - h * 10)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
