"""Queries over depth maps and their metric scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.operators import depth
from aerolith.plans.views import table

QUERIES: dict = {}
ORACLE: dict = {}
SIZE = (64, 48)
PIXELS = """(SELECT l_suppkey % 25 AS job, l_suppkey AS frame, l_orderkey % 64 AS v, l_partkey % 48 AS u, min(l_extendedprice) / 1000 AS depth
  FROM lineitem GROUP BY ALL)"""
POSES = """(SELECT s_suppkey % 25 AS job, s_suppkey AS frame, s_suppkey * 0.7::DOUBLE AS e, (s_suppkey % 7) * 1.3::DOUBLE AS n, abs(CAST(s_acctbal AS DOUBLE)) % 40 AS up,
  CASE WHEN s_suppkey % 3 <> 0 THEN 20.0::DOUBLE + s_suppkey % 50 END AS agl FROM supplier)"""
#: Points of every frame, unit vectors times depth, and places near twice of these. A point without depth isn't seen; there are frames that see most of theirs, few, or none.
POINTS = """(SELECT l_suppkey % 25 AS job, l_suppkey AS frame, CAST(l_quantity AS DOUBLE) AS ax, round(l_discount * 100) AS ay, l_extendedprice / 1000 AS az,
  2 * CAST(l_quantity AS DOUBLE) + l_linenumber % 3 AS bx, 2 * round(l_discount * 100) - l_linenumber % 2 AS by_, 2 * (l_extendedprice / 1000) AS bz, CASE WHEN l_partkey % (1 + l_suppkey % 40 * 30) = 0 THEN l_extendedprice / 1000 ELSE 0.0 END AS depth
  FROM lineitem)"""


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.bround(c, digits) for c in names})


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    keys = [(F.col("l_suppkey") % 25).alias("job"), F.col("l_suppkey").alias("frame"), (F.col("l_orderkey") % 64).alias("v"), (F.col("l_partkey") % 48).alias("u")]
    return table(spark, d, "lineitem").groupBy(*keys).agg((F.min("l_extendedprice") / 1000).alias("depth"))


def _poses(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("s_suppkey")
    agl = F.when(i % 3 != 0, 20.0 + i % 50)
    return table(spark, d, "supplier").select(
        (i % 25).alias("job"), i.alias("frame"), (i * 0.7).alias("e"), ((i % 7) * 1.3).alias("n"), (F.abs(F.col("s_acctbal").cast("double")) % 40).alias("up"), agl.alias("agl")
    )


def _points(spark: SparkSession, d: str) -> DataFrame:
    q, y, z = F.col("l_quantity").cast("double"), F.round(F.col("l_discount") * 100), F.col("l_extendedprice") / 1000
    rows = table(spark, d, "lineitem")
    seen = F.when(F.col("l_partkey") % (1 + F.col("l_suppkey") % 40 * 30) == 0, z).otherwise(0.0)
    world = [(2 * q + F.col("l_linenumber") % 3).alias("bx"), (2 * y - F.col("l_linenumber") % 2).alias("by"), (2 * z).alias("bz")]
    return rows.select((F.col("l_suppkey") % 25).alias("job"), F.col("l_suppkey").alias("frame"), q.alias("ax"), y.alias("ay"), z.alias("az"), *world, seen.alias("depth"))


@query(f"""
SELECT job, frame, count(ok) AS valid, round_even(coalesce(min(ok), 0), 6) AS low, round_even(coalesce(max(ok), 0), 6) AS high, round_even(coalesce(median(ok), 0), 6) AS middle
FROM (SELECT *, CASE WHEN depth BETWEEN 0.1 AND 300 THEN depth END AS ok FROM {PIXELS}) GROUP BY job, frame""")
def depth_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(depth.depth_stats(_pixels(spark, d)), "low", "high", "middle")


_BASELINE = f"""
m AS (SELECT frame, CASE WHEN count(*) > 10 THEN median(depth) ELSE 0.0 END AS middle FROM {PIXELS} WHERE v BETWEEN 24 AND 39 AND u BETWEEN 18 AND 29 AND depth BETWEEN 0.1 AND 250 GROUP BY frame),
p AS (SELECT p.*, coalesce(middle, 0) AS middle FROM {POSES} p LEFT JOIN m USING (frame)),
l AS (SELECT *, sqrt(pow(e - lag(e) OVER w, 2) + pow(n - lag(n) OVER w, 2) + pow(up - lag(up) OVER w, 2)) AS way, abs(middle - lag(middle) OVER w) AS change FROM p WINDOW w AS (PARTITION BY job ORDER BY frame)),
gps AS (SELECT *, CASE WHEN way >= 0.1 AND change >= 0.001 AND way / change BETWEEN 0.01 AND 1000 THEN way / change END AS scale_gps FROM l)"""


@query(f"WITH {_BASELINE} SELECT job, frame, round_even(way, 6) AS way, round_even(change, 6) AS change, round_even(scale_gps, 6) AS scale_gps FROM gps")
def baseline_scale(spark: SparkSession, d: str) -> DataFrame:
    out = depth.baseline_scale(_pixels(spark, d), _poses(spark, d), SIZE)
    return rounded(out, "way", "change", "scale_gps").select("job", "frame", "way", "change", "scale_gps")


_BARO = f"""
k AS (SELECT frame, CASE WHEN count(*) >= 10 THEN median(depth) END AS nadir FROM {PIXELS} WHERE v BETWEEN 27 AND 36 AND u BETWEEN 19 AND 28 AND depth BETWEEN 0.1 AND 300 GROUP BY frame),
baro AS (SELECT p.job, p.frame, agl, nadir, CASE WHEN agl >= 1 AND nadir >= 0.001 AND agl / nadir BETWEEN 0.01 AND 1000 THEN agl / nadir END AS scale_baro FROM {POSES} p LEFT JOIN k USING (frame))"""


@query(f"WITH {_BARO} SELECT job, frame, round_even(nadir, 6) AS nadir, round_even(scale_baro, 6) AS scale_baro FROM baro")
def barometric_scale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(depth.barometric_scale(_pixels(spark, d), _poses(spark, d), SIZE), "nadir", "scale_baro").select("job", "frame", "nadir", "scale_baro")


_SPARSE = f"""
a AS (SELECT * FROM {POINTS} WHERE depth >= 0.01),
f AS (SELECT job, frame, sum(ax * bx + ay * by_ + az * bz) / sum(ax * ax + ay * ay + az * az) AS s FROM a GROUP BY job, frame HAVING count(*) >= 5 AND sum(ax * ax + ay * ay + az * az) >= 1e-9),
sparse AS (SELECT a.job, a.frame, any_value(s) AS scale_sparse, count(*) AS n, avg(sqrt(pow(s * ax - bx, 2) + pow(s * ay - by_, 2) + pow(s * az - bz, 2))) AS residual
  FROM a JOIN f ON f.job = a.job AND f.frame = a.frame WHERE s BETWEEN 0.01 AND 1000 GROUP BY a.job, a.frame)"""


@query(f"WITH {_SPARSE} SELECT job, frame, n, round_even(scale_sparse, 6) AS scale_sparse, round_even(residual, 6) AS residual FROM sparse")
def sparse_scale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(depth.sparse_scale(_points(spark, d)), "scale_sparse", "residual")


_ALIGNED = f"""
{_BASELINE}, {_BARO}, {_SPARSE},
c AS (SELECT gps.job, gps.frame, coalesce(scale_sparse, scale_gps, scale_baro, 1.0) AS raw,
    CASE WHEN scale_sparse IS NOT NULL THEN 'SPARSE_3D' WHEN scale_gps IS NOT NULL THEN 'GPS_BASELINE' WHEN scale_baro IS NOT NULL THEN 'BAROMETRIC' ELSE 'MEDIAN_PROPAGATION' END AS mode,
    CASE WHEN scale_sparse IS NOT NULL THEN sparse.n WHEN scale_gps IS NOT NULL THEN 2 WHEN scale_baro IS NOT NULL THEN 1 ELSE 0 END AS points, coalesce(residual, 0) AS residual
  FROM gps JOIN baro USING (frame) LEFT JOIN sparse USING (frame)),
s AS (SELECT *, median(raw) OVER (PARTITION BY job ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM c)"""


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    pixels, poses = _pixels(spark, d), _poses(spark, d)
    sparse = depth.sparse_scale(_points(spark, d)).withColumnsRenamed({"n": "n_sparse", "residual": "residual_sparse"})
    frames = depth.baseline_scale(pixels, poses, SIZE).join(depth.barometric_scale(pixels, poses, SIZE).select("job", "frame", "scale_baro"), ["job", "frame"])
    return depth.aligned(depth.chosen_scale(frames.join(sparse, ["job", "frame"], "left")))


@query(f"WITH {_ALIGNED} SELECT job, frame, mode, points, round_even(raw, 6) AS raw, round_even(smooth, 6) AS smooth, round_even(residual, 4) AS residual FROM s")
def scale_alignment(spark: SparkSession, d: str) -> DataFrame:
    """The scale of every frame, by the best source that it has, smoothed along its job."""
    out = rounded(_aligned(spark, d), "raw", "smooth").withColumn("residual", F.bround("residual", 4))
    return out.select("job", "frame", "mode", "points", "raw", "smooth", "residual")


@query(f"""
WITH {_ALIGNED}, modes AS (SELECT job, mode, count(*) AS n, min(frame) AS f FROM s GROUP BY job, mode), top AS (SELECT job, arg_max(mode, row(n, -f)) AS mode FROM modes GROUP BY job)
SELECT s.job, count(*) AS frames, round_even(median(smooth), 6) AS scale, round_even(avg(residual), 4) AS residual, any_value(top.mode) AS mode,
  CASE WHEN bool_or(s.mode IN ('GPS_BASELINE', 'BAROMETRIC')) THEN avg(residual) / 50.0 <= 0.05 END AS baro_ok FROM s JOIN top ON top.job = s.job GROUP BY s.job""")
def scale_report(spark: SparkSession, d: str) -> DataFrame:
    out = depth.alignment_report(_aligned(spark, d))
    return rounded(out, "scale").withColumn("residual", F.bround("residual", 4))


@query(f"""
WITH {_ALIGNED}, metric AS (SELECT p.job, p.frame, greatest(0, least(500, depth * smooth)) AS depth FROM {PIXELS} p JOIN s ON s.job = p.job AND s.frame = p.frame),
ok AS (SELECT job, frame, depth, CASE WHEN depth BETWEEN 0.3 AND 300 THEN depth END AS x FROM metric)
SELECT job, frame, count(x) AS valid, round_even(coalesce(min(x), 0), 5) AS low, round_even(coalesce(max(x), 0), 5) AS high, round_even(coalesce(median(x), 0), 5) AS middle FROM ok GROUP BY job, frame""")
def calibrated_depth(spark: SparkSession, d: str) -> DataFrame:
    """Depth statistics of every frame in metres."""
    rows = depth.calibrated(_pixels(spark, d), _aligned(spark, d))
    return rounded(depth.depth_stats(rows, depth.CALIBRATED_RANGE), "low", "high", "middle", digits=5)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0, least(255, CAST(trunc((l_partkey % 300 + l_suppkey % 256 + l_orderkey % 100) / 3.0) AS INT))) AS confidence FROM lineitem")
def depth_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Three scores of a pixel fused to one."""
    parts = [F.col("l_partkey") % 300, F.col("l_suppkey") % 256, F.col("l_orderkey") % 100]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", depth.fused_confidence(parts).alias("confidence"))
