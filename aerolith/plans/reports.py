"""Queries over video, pose and accuracy reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.functions import geodesy, poses, reports, rules
from aerolith.plans.depths import rounded
from aerolith.plans.views import sql, table, view

QUERIES: dict = {}
ORACLE: dict = {}
TEL, OBS, FRAMES = sql("telemetry"), sql("observations"), sql("frames")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


_VIDEO = """(SELECT event_id, [1280, 1920, 3840, 1920][1 + event_id % 4] AS w, [720, 1080, 2160, 1080][1 + event_id % 4] AS h, event_id % 60 / 2 AS rate,
  (event_id * 3 % 100)::DOUBLE AS blur, (event_id * 7 % 100)::DOUBLE AS compression, (event_id * 11 % 100)::DOUBLE AS exposure FROM events)"""


@query(f"""
WITH v AS (SELECT *, w >= 3840 OR h >= 2160 AS uhd, w >= 1920 OR h >= 1080 AS hd FROM {_VIDEO}),
c AS (SELECT *, CASE WHEN hd AND rate > 0 AND rate < 4 THEN least(compression, rate * 12) WHEN uhd AND rate > 0 AND rate < 12 THEN least(compression, rate * 4) ELSE compression END AS capped FROM v)
SELECT event_id, round_even(capped, 2) AS compression, array_to_string(list_filter([CASE WHEN NOT hd THEN 'RESOLUTION_BELOW_1080P' END,
  CASE WHEN uhd AND rate < 25 THEN 'HIGH_VIDEO_COMPRESSION_4K' WHEN hd AND NOT uhd AND rate < 8 THEN 'HIGH_VIDEO_COMPRESSION_1080P' END, CASE WHEN blur < 60 THEN 'HIGH_MOTION_BLUR' END,
  CASE WHEN capped < 60 THEN 'SEVERE_COMPRESSION_ARTIFACTS' END, CASE WHEN exposure < 60 THEN 'POOR_EXPOSURE_BALANCE' END], lambda x: x IS NOT NULL), ',') AS warnings FROM c""")
def video_report(spark: SparkSession, d: str) -> DataFrame:
    """Warnings of videos and their compression score, capped where the bitrate is very low."""
    i = F.col("event_id")
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), (i % 4).cast("int"))
    score = lambda k: (i * k % 100).cast("double")
    v = table(spark, d, "events").select("event_id", pick(1280, 1920, 3840, 1920).alias("w"), pick(720, 1080, 2160, 1080).alias("h"), (i % 60 / 2).alias("rate"), score(3).alias("blur"), score(7).alias("compression"), score(11).alias("exposure"))
    w, h, rate = F.col("w"), F.col("h"), F.col("rate")
    v = v.withColumn("compression", F.bround(reports.capped_compression(F.col("compression"), w, h, rate), 2))
    warnings = reports.video_warnings(w, h, rate, F.col("blur"), F.col("compression"), F.col("exposure"))
    return v.select("event_id", "compression", F.array_join(warnings, ",").alias("warnings"))


@query("SELECT user_id AS flight_id, round_even(avg(event_id * 3 % 100), 2) AS blur, round_even(avg(event_id * 7 % 100), 2) AS exposure, round_even(greatest(0, least(100, 100 - 3.5 * stddev_pop(event_id * 13 % 40))), 2) AS illumination FROM events GROUP BY user_id")
def visual_quality(spark: SparkSession, d: str) -> DataFrame:
    """Means of the scores of a flight's frames, and how steady their light is."""
    i = F.col("event_id")
    out = table(spark, d, "events").groupBy(F.col("user_id").alias("flight_id")).agg(F.avg(i * 3 % 100).alias("blur"), F.avg(i * 7 % 100).alias("exposure"), reports.illumination(i * 13 % 40).alias("illumination"))
    return rounded(out, "blur", "exposure", "illumination", digits=2)


_MODE = "CASE WHEN event_id % 11 = 0 THEN 'VISUAL_ONLY' WHEN event_type = 'purchase' THEN 'RTK' WHEN event_id % 7 > 4 OR event_id % 13 < 6 THEN 'GPS_DEGRADED' WHEN event_id % 2 = 0 THEN 'GPS_IMU' ELSE 'GPS_ONLY' END"


@query(f"SELECT event_id, mode, CASE WHEN mode IN ('VISUAL_ONLY', 'RTK') THEN mode WHEN event_id % 3 = 0 AND mode <> 'GPS_ONLY' THEN 'BAROMETRIC' ELSE 'GPS_BASELINE' END AS source FROM (SELECT event_id, {_MODE} AS mode FROM events)")
def accuracy_modes(spark: SparkSession, d: str) -> DataFrame:
    """Positioning mode and source of scale by the sensors at hand."""
    i = F.col("event_id")
    mode = reports.accuracy_mode(F.col("event_type") == "purchase", i % 2 == 0, (i % 7).cast("double"), i % 13, i % 11 == 0)
    return table(spark, d, "events").select("event_id", mode.alias("mode")).select("event_id", "mode", reports.scale_source(F.col("mode"), i % 3 == 0).alias("source"))


_REPORT = f"""
z AS (SELECT cls, (l_orderkey % 30) / 20 AS dx, (l_partkey % 5) / 10 AS dy, (l_suppkey % 17) / 10 AS dz, conf_pct FROM {OBS}),
g AS (SELECT cls, sqrt(avg(dx * dx + dy * dy)) AS horizontal, sqrt(avg(dz * dz)) AS vertical, avg(conf_pct) / 60 AS reprojection, 84.0::DOUBLE + 2 * cls AS coverage, 60.0::DOUBLE + 5 * cls AS observed, 22.0::DOUBLE - 3 * cls AS inferred, cls / 4 AS dirt,
  cls % 4 = 1 AS rtk, cls % 3 = 0 AS baro, CASE WHEN cls % 4 = 1 THEN 'RTK' WHEN cls % 4 = 2 THEN 'GPS_DEGRADED' ELSE 'GPS_IMU' END AS mode FROM z GROUP BY cls),
q AS (SELECT *, greatest(0, least(100, 0.3 * coverage + 0.3 * (0.6 * greatest(0, 100 - horizontal * 30) + 0.4 * greatest(0, 100 - vertical / 1.5 * 20)) + 0.2 * greatest(0, 100 - reprojection * 25) + 0.2 * (observed * 0.8 + coverage * 0.2) - dirt * 1.5)) AS quality,
  CASE WHEN coverage >= 90 THEN 1.0 ELSE 1.5 END AS a, CASE WHEN reprojection < 1.2 THEN 0.5 ELSE 0.8 END AS b FROM g)"""


@query(f"""
WITH {_REPORT}
SELECT cls, round_even(quality, 1) AS quality, round_even(horizontal, 3) AS horizontal, round_even(vertical, 3) AS vertical, CASE WHEN horizontal <= 0.5 THEN 'HIGH' WHEN horizontal <= 1.2 THEN 'MEDIUM' ELSE 'LOW' END AS geolocation, mode,
  CASE WHEN mode = 'RTK' THEN mode WHEN baro THEN 'BAROMETRIC' ELSE 'GPS_BASELINE' END AS source,
  round_even(sqrt(a * a + b * b + 0.09) + greatest(0, inferred - 15) * 0.05, 2) AS measurement, round_even(CASE WHEN rtk THEN 0.05 ELSE 0.4 END, 3) AS h_uncertainty, round_even(CASE WHEN rtk THEN 0.08 ELSE 0.6 + CASE WHEN baro THEN 0.15 ELSE 0.4 END END, 3) AS v_uncertainty,
  array_to_string(list_filter([CASE WHEN horizontal > 0.5 THEN 'HORIZONTAL_RMSE' END, CASE WHEN vertical > 0.75 THEN 'VERTICAL_RMSE' END, CASE WHEN inferred > 15 OR observed < 70 THEN 'INFERRED_SURFACE' END, CASE WHEN mode = 'GPS_DEGRADED' THEN 'APPROXIMATE_POSITION' END], lambda x: x IS NOT NULL), ',') AS warnings
FROM q""")
def accuracy_report(spark: SparkSession, d: str) -> DataFrame:
    """Quality, errors, uncertainties and warnings of each job (here: class of points)."""
    dx, dy, dz = F.col("l_orderkey") % 30 / 20, F.col("l_partkey") % 5 / 10, F.col("l_suppkey") % 17 / 10
    c, flat = F.col("cls"), dx * dx + dy * dy
    g = view(spark, d, "observations").groupBy("cls").agg(F.sqrt(F.avg(flat)).alias("horizontal"), F.sqrt(F.avg(dz * dz)).alias("vertical"), (F.avg("conf_pct") / 60).alias("reprojection"))
    g = g.select("*", (84.0 + 2 * c).alias("coverage"), (60.0 + 5 * c).alias("observed"), (22.0 - 3 * c).alias("inferred"), (c / 4).alias("dirt"), (c % 4 == 1).alias("rtk"), (c % 3 == 0).alias("baro"))
    none = F.lit(None).cast("double")
    g = g.withColumn("mode", reports.accuracy_mode(F.col("rtk"), F.lit(True), F.when(c % 4 == 2, 5.0), none, F.lit(False)))
    h, v, o, inferred = (F.col(x) for x in ("horizontal", "vertical", "observed", "inferred"))
    depth, pose = F.when(F.col("coverage") >= 90, "HIGH").otherwise("MEDIUM"), F.when(F.col("reprojection") < 1.2, "HIGH").otherwise("MEDIUM")
    eh, ev = reports.expected_uncertainty(F.col("rtk"), F.col("baro"), F.lit(0.4), F.lit(0.6))
    return g.select(
        "cls",
        F.bround(reports.overall_quality(F.col("coverage"), h, v, F.col("reprojection"), o, F.col("dirt")), 1).alias("quality"),
        F.bround(h, 3).alias("horizontal"),
        F.bround(v, 3).alias("vertical"),
        reports.geolocation_class(h).alias("geolocation"),
        "mode",
        reports.scale_source(F.col("mode"), F.col("baro")).alias("source"),
        F.bround(rules.uncertainty(depth, pose, inferred), 2).alias("measurement"),
        F.bround(eh, 3).alias("h_uncertainty"),
        F.bround(ev, 3).alias("v_uncertainty"),
        F.array_join(reports.accuracy_warnings(h, v, o, inferred, F.col("mode")), ",").alias("warnings"),
    )


_SIGMA = "greatest(0, least(100, CASE WHEN event_type = 'purchase' THEN 100 - h / 0.02 * 10 WHEN event_type <> 'error' THEN 100 - h / 2 * 20 ELSE 70 - h * 10 END))"


@query(f"WITH s AS (SELECT *, sqrt(pow(event_id % 19 / 100, 2) + pow(event_id % 23 / 50, 2)) / sqrt(2) AS h FROM events) SELECT user_id AS flight_id, count(*) AS poses, round_even(avg({_SIGMA}), 2) AS confidence FROM s GROUP BY user_id")
def mean_pose_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The mean confidence of a flight's poses, from their sigmas."""
    i, kind = F.col("event_id"), F.col("event_type")
    score = poses.sigma_confidence(i % 19 / 100, i % 23 / 50, kind == "purchase", kind != "error")
    out = table(spark, d, "events").groupBy(F.col("user_id").alias("flight_id")).agg(F.count(F.lit(1)).alias("poses"), F.avg(score).alias("confidence"))
    return rounded(out, "confidence", digits=2)


_HALF = "radians(event_id * 7 % 170) / 2 AS y, radians(event_id * 5 % 80 - 40) / 2 AS p, radians(event_id * 3 % 60 - 30) / 2 AS r"


@query(f"""
WITH h AS (SELECT event_id, {_HALF} FROM events)
SELECT event_id, round_even(cos(y) * cos(p) * sin(r) - sin(y) * sin(p) * cos(r), 6) + 0.0 AS qx, round_even(cos(y) * sin(p) * cos(r) + sin(y) * cos(p) * sin(r), 6) + 0.0 AS qy,
  round_even(sin(y) * cos(p) * cos(r) - cos(y) * sin(p) * sin(r), 6) + 0.0 AS qz, round_even(cos(y) * cos(p) * cos(r) + sin(y) * sin(p) * sin(r), 6) + 0.0 AS qw, true AS turned_back FROM h""")
def gimbal_quaternions(spark: SparkSession, d: str) -> DataFrame:
    """Angles to a matrix to a quaternion; and whether matrix to vector to matrix gives the same again."""
    i = F.col("event_id")
    r = poses.euler_zyx((i * 7 % 170).cast("double"), (i * 5 % 80 - 40).cast("double"), (i * 3 % 60 - 30).cast("double"))
    rows = table(spark, d, "events").select("event_id", *[r[a][b].alias(f"r{a}{b}") for a in range(3) for b in range(3)])
    m = [[F.col(f"r{a}{b}") for b in range(3)] for a in range(3)]
    rows = rows.select("*", *[c.alias(n) for n, c in zip(("qx", "qy", "qz", "qw"), poses.quaternion(m), strict=True)], *[c.alias(f"v{k}") for k, c in enumerate(poses.rotation_vector(m))])
    again = poses.from_rotation_vector([F.col(f"v{k}") for k in range(3)])
    gap = F.greatest(*[F.abs(again[a][b] - m[a][b]) for a in range(3) for b in range(3)])
    sign = F.when(F.col("qw") < 0, -1.0).otherwise(1.0)
    return rows.select("event_id", *[(F.bround(F.col(n) * sign, 6) + 0.0).alias(n) for n in ("qx", "qy", "qz", "qw")], (gap < 1e-9).alias("turned_back"))


_FOCAL = "(2000 / tan(radians(70.0) / 2))"


@query(f"""
WITH o AS (SELECT frame, cls, x - frame % 5 AS px, y - frame % 3 AS py, z - (-120 + 20 * (frame % 9)) AS zc, cos(radians(frame * 13 % 360)) AS c, sin(radians(frame * 13 % 360)) AS s FROM {OBS}),
p AS (SELECT frame, cls, zc, {_FOCAL} * (c * px + s * py) / zc + 2000 AS u, {_FOCAL} * (c * py - s * px) / zc + 1500 AS v FROM o WHERE zc > 1e-6)
SELECT frame, round_even(CASE WHEN count(p.zc) >= 4 THEN sqrt(avg(pow(cls % 3 - 1, 2) + pow(cls % 2, 2))) ELSE 0 END, 4) AS rmse, count(p.zc) AS ahead, round_even(avg(u), 4) AS mean_u, round_even(avg(v), 4) AS mean_v FROM p GROUP BY frame""")
def reprojection_errors(spark: SparkSession, d: str) -> DataFrame:
    """Points projected into each frame's camera (no calibration given), and how far from where they were seen."""
    f = F.col("frame")
    rotation = poses.euler_zyx((f * 13 % 360).cast("double"), F.lit(0.0), F.lit(0.0))
    r, t = poses.world_to_camera(rotation, [(f % 5).cast("double"), (f % 3).cast("double"), (-120 + 20 * (f % 9)).cast("double")])
    none = F.lit(None).cast("double")
    k = poses.intrinsics(F.lit(4000.0), F.lit(3000.0), none, none, none, none)
    u, v, z = poses.projected(r, t, k, [F.col("x"), F.col("y"), F.col("z")])
    rows = view(spark, d, "observations").select("frame", u.alias("u"), v.alias("v"), z.alias("depth"), (F.col("cls") % 3 - 1).alias("eu"), (F.col("cls") % 2).alias("ev"))
    ahead = F.col("depth") > 1e-6
    rmse = poses.reprojection_rmse(F.col("u"), F.col("v"), F.col("depth"), F.col("u") - F.col("eu"), F.col("v") - F.col("ev"))
    out = rows.groupBy("frame").agg(rmse.alias("rmse"), F.count_if(ahead).alias("ahead"), F.avg(F.when(ahead, F.col("u"))).alias("mean_u"), F.avg(F.when(ahead, F.col("v"))).alias("mean_v"))
    return rounded(out.filter("ahead > 0"), "rmse", "mean_u", "mean_v", digits=4)


@query(f"""
WITH v AS (SELECT *, row_number() OVER (PARTITION BY flight_id, event_type ORDER BY t, seq) AS i FROM {TEL}), a AS (SELECT * FROM v WHERE event_type = 'purchase'), b AS (SELECT * FROM v WHERE event_type = 'click'),
z AS (SELECT flight_id, (a.lon - b.lon) * 1e5 AS dx, (a.lat - b.lat) * 1e5 AS dy, (a.alt - b.alt) / 100 AS dz FROM a JOIN b USING (flight_id, i))
SELECT flight_id, count(*) AS pairs, round_even(sqrt(avg(dx * dx + dy * dy)), 5) AS horizontal, round_even(sqrt(avg(dz * dz)), 5) AS vertical FROM z GROUP BY flight_id HAVING count(*) >= 3""")
def ordinal_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Estimated and reference positions of a flight paired by ordinal, as far as the shorter of both goes; three pairs at least."""
    v = view(spark, d, "telemetry").withColumn("i", F.row_number().over(Window.partitionBy("flight_id", "event_type").orderBy("t", "seq")))
    side = lambda kind, p: v.filter(F.col("event_type") == kind).select("flight_id", "i", *[F.col(c).alias(f"{p}{c}") for c in ("lon", "lat", "alt")])
    z = side("purchase", "a").join(side("click", "b"), ["flight_id", "i"])
    dx, dy, dz = (F.col("alon") - F.col("blon")) * 1e5, (F.col("alat") - F.col("blat")) * 1e5, (F.col("aalt") - F.col("balt")) / 100
    out = z.groupBy("flight_id").agg(F.count(F.lit(1)).alias("pairs"), F.sqrt(F.avg(dx * dx + dy * dy)).alias("horizontal"), F.sqrt(F.avg(dz * dz)).alias("vertical"))
    return rounded(out.filter("pairs >= 3"), "horizontal", "vertical", digits=5)


@query(f"WITH k AS (SELECT job_id, frame_index, row_number() OVER (PARTITION BY job_id ORDER BY frame_index) - 1 AS pose FROM {FRAMES} WHERE frame_index % 3 = 0) SELECT f.job_id, f.frame_index, pose, round_even(blur, 4) AS blur FROM {FRAMES} f JOIN k USING (job_id, frame_index)")
def pose_index(spark: SparkSession, d: str) -> DataFrame:
    """Sensor observations by the ordinal of their keyframe; those without a keyframe go."""
    f = view(spark, d, "frames")
    k = f.filter("frame_index % 3 = 0").select("job_id", "frame_index", (F.row_number().over(Window.partitionBy("job_id").orderBy("frame_index")) - 1).alias("pose"))
    return f.join(k, ["job_id", "frame_index"]).select("job_id", "frame_index", "pose", F.bround("blur", 4).alias("blur"))


@query(f"SELECT f.job_id, f.frame_index, round_even(coalesce(k.blur, 75.0), 4) AS blur FROM {FRAMES} f LEFT JOIN (SELECT * FROM {FRAMES} WHERE frame_index % 4 <> 1) k USING (job_id, frame_index)")
def frame_blur(spark: SparkSession, d: str) -> DataFrame:
    """The cached blur score of each frame, 75 where there is none."""
    f = view(spark, d, "frames")
    cache = f.filter("frame_index % 4 <> 1").select("job_id", "frame_index", F.col("blur").alias("known"))
    return f.join(cache, ["job_id", "frame_index"], "left").select("job_id", "frame_index", F.bround(F.coalesce("known", F.lit(75.0)), 4).alias("blur"))


@query("SELECT event_id, round_even(37 + degrees((event_id % 997) / 6378137.0), 9) AS lat, round_even(-122 + degrees((event_id % 991) / (6378137.0 * cos(radians(37.0)))), 9) AS lon, 10.0::DOUBLE + event_id % 50 AS alt FROM events")
def flat_geodetic(spark: SparkSession, d: str) -> DataFrame:
    """East, north and up back to degrees on a tangent plane."""
    i = F.col("event_id")
    lat, lon, alt = geodesy.flat_geodetic((i % 991).cast("double"), (i % 997).cast("double"), (i % 50).cast("double"), F.lit(37.0), F.lit(-122.0), F.lit(10.0))
    return table(spark, d, "events").select("event_id", F.bround(lat, 9).alias("lat"), F.bround(lon, 9).alias("lon"), alt.alias("alt"))


@query("SELECT event_id, round_even(2 * -(event_id % 13) + 10, 6) AS x, round_even(2 * (event_id % 17) - 5, 6) AS y, round_even(2 * (event_id % 7) + 3, 6) AS z FROM events")
def similarity_apply(spark: SparkSession, d: str) -> DataFrame:
    """A similarity (scale 2, a quarter turn, a shift) applied to points."""
    i = F.col("event_id")
    p = geodesy.similarity(*[(i % n).cast("double") for n in (17, 13, 7)], 2.0, [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [10.0, -5.0, 3.0])
    return table(spark, d, "events").select("event_id", *[F.bround(c, 6).alias(n) for n, c in zip("xyz", p, strict=True)])


@query("SELECT event_id, CASE WHEN event_id % 3 = event_id % 5 THEN event_id % 5 ELSE event_id % 2 END AS cls, CASE WHEN event_id % 4 = 0 THEN 80 ELSE 240 END AS texture, event_id % 101 + 100 - event_id % 101 = 100 AS whole FROM events")
def face_rules(spark: SparkSession, d: str) -> DataFrame:
    """The class two corners of a face share, else that of the first; the confidence of its texture; shares that make a hundred."""
    i = F.col("event_id")
    whole = reports.sums_to_hundred((i % 101).cast("double"), 100.0 - i % 101)
    return table(spark, d, "events").select("event_id", rules.majority(i % 2, i % 3, i % 5).alias("cls"), rules.texture_confidence(i % 4 == 0).alias("texture"), whole.alias("whole"))
