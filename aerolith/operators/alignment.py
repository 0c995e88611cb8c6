"""Fitting similarity transforms, local planes and descriptor matches.

Sums over all rows are Spark aggregates; only 3 x 3 matrices reach numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_AXES = ("x", "y", "z")


def umeyama(pairs: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and shift from (sx, sy, sz) to (tx, ty, tz), least squares; the identity for fewer than three pairs.

    One pass of moments about the first values' means, which come first, so that large coordinates lose no digits.
    """
    sides = [f"{side}{c}" for side in "st" for c in _AXES]
    means = pairs.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in sides]).first()
    if means["n"] < 3:
        return 1.0, np.eye(3), np.zeros(3)
    at = {c: F.col(c) - F.lit(means[c]) for c in sides}
    sums = pairs.agg(*[F.avg(at[f"t{a}"] * at[f"s{b}"]).alias(a + b) for a in _AXES for b in _AXES], F.avg(sum((at[f"s{c}"] * at[f"s{c}"] for c in "yz"), at["sx"] * at["sx"])).alias("variance")).first()
    u, d, vt = np.linalg.svd(np.array([[sums[a + b] for b in _AXES] for a in _AXES]))
    sign = np.diag([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
    rotation = u @ sign @ vt
    scale = float((d * np.diag(sign)).sum() / sums["variance"]) if sums["variance"] > 1e-12 else 1.0
    source, target = (np.array([means[f"{side}{c}"] for c in _AXES]) for side in "st")
    return scale, rotation, target - scale * rotation @ source


def local_planes(near: DataFrame, key: str) -> DataFrame:
    """key, nx, ny, nz, curvature from the neighbours (key, x, y, z) of each point.

    The covariance is a native aggregate; its smallest eigenvector is found for many rows at once.
    """
    cov = near.groupBy(key).agg(*[F.covar_pop(a, b).alias(a + b) for i, a in enumerate(_AXES) for b in _AXES[i:]])

    def run(parts):
        for p in parts:
            m = np.stack([np.stack([p["xx"], p["xy"], p["xz"]], -1), np.stack([p["xy"], p["yy"], p["yz"]], -1), np.stack([p["xz"], p["yz"], p["zz"]], -1)], -2)
            values, vectors = np.linalg.eigh(m)
            total = np.maximum(values.sum(-1), 1e-12)
            yield pd.DataFrame({key: p[key], "nx": vectors[:, 0, 0], "ny": vectors[:, 1, 0], "nz": vectors[:, 2, 0], "curvature": values[:, 0] / total})

    return cov.mapInPandas(run, f"{key} long, nx double, ny double, nz double, curvature double")


#: Descriptors of a block.
BLOCK = 1024


def _two_nearest(cell: pd.DataFrame) -> pd.DataFrame:
    """The two nearest of the right side for each of the left: products tell which may be, differences which are."""
    left, right = cell[cell["side"] == 0], cell[cell["side"] == 1]
    a, b = left["id"].to_numpy(), right["id"].to_numpy()
    found = [pd.DataFrame({"a": a[:0], "b": b[:0], "d": np.zeros(0)})]
    if len(a) and len(b):
        v, w = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        vv, ww = (v * v).sum(1), (w * w).sum(1)
        for at in range(0, len(a), 256):
            some = slice(at, at + 256)
            near = vv[some, None] + ww - 2 * (v[some] @ w.T)
            near[a[some, None] == b] = np.inf
            cut = np.partition(near, 1, axis=1)[:, 1] if len(b) > 1 else near[:, 0]
            i, j = np.nonzero((near <= (cut + 1e-9 * (vv[some] + ww.max() + 1))[:, None]) & np.isfinite(near))
            d = np.sqrt(((v[some][i] - w[j]) ** 2).sum(1))
            rows = pd.DataFrame({"a": a[some][i], "i": i, "b": b[j], "d": d}).sort_values(["i", "d", "b"])
            found.append(rows.groupby("i").head(2)[["a", "b", "d"]])
    return pd.concat(found)


def ratio_matches(left: DataFrame, right: DataFrame, by: str, ratio: float = 0.75, block: int = BLOCK) -> DataFrame:
    """a, b, d: the nearest descriptor of right for each of left (by, id, v) in the same group, if it is much nearer than the second.

    Both sides of a group are dealt in blocks by hash, as many as its size needs, and each pair of blocks is compared on its own; it sends the
    two nearest of each descriptor. All descriptors have one length; those with a null id, group or vector take no part.
    """
    left, right = (x.select(by, "id", "v").filter(F.col("id").isNotNull() & F.col("v").isNotNull()) for x in (left, right))
    sizes = [x.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / block).alias(name)) for x, name in ((left, "nl"), (right, "nr"))]
    sizes = sizes[0].join(sizes[1], by)
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    l_rows = left.join(sizes, by).select(by, own("nl").alias("lb"), every("nr").alias("rb"), F.lit(0).alias("side"), "id", "v")
    r_rows = right.join(sizes, by).select(by, every("nl").alias("lb"), own("nr").alias("rb"), F.lit(1).alias("side"), "id", "v")
    rows = l_rows.unionByName(r_rows).groupBy(by, "lb", "rb").applyInPandas(_two_nearest, "a long, b long, d double")
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).filter("n <= 2")
    best = ranked.groupBy("a").agg(F.min(F.struct("d", "b")).alias("first"), F.max("d").alias("second"), F.count(F.lit(1)).alias("k"))
    return best.filter((F.col("k") == 2) & (F.col("first.d") < ratio * F.col("second"))).select("a", F.col("first.b").alias("b"), F.col("first.d").alias("d"))
