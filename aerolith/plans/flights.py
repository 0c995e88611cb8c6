"""Queries over telemetry and the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.functions import geodesy, rules
from aerolith.operators import relational, telemetry
from aerolith.operators.asof import asof_join
from aerolith.plans.views import sql, table, view

QUERIES: dict = {}
ORACLE: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.bround(c, digits) for c in names})


_HAV = "2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a))"
_TRAJECTORY = f"""
steps AS (
  SELECT flight_id, t - lag(t) OVER w AS dt,
    pow(sin(radians(lat - lag(lat) OVER w) / 2), 2) + cos(radians(lag(lat) OVER w)) * cos(radians(lat)) * pow(sin(radians(lon - lag(lon) OVER w) / 2), 2) AS a,
    CASE WHEN rel > 0 THEN rel WHEN baro > 0 THEN baro ELSE greatest(10.0, alt - min(alt) OVER (PARTITION BY flight_id)) END AS height
  FROM {sql("telemetry")} WINDOW w AS (PARTITION BY flight_id ORDER BY t, seq)
),
measured AS (SELECT flight_id, dt, height, {_HAV} AS dist, CASE WHEN dt > 0 THEN {_HAV} / dt END AS speed FROM steps),
found AS (
  SELECT flight_id, count(*) AS fixes, coalesce(max(CASE WHEN dt > 0 THEN dt END), 0) AS max_gap, coalesce(max(speed), 0) AS max_speed, coalesce(avg(speed), 0) AS avg_speed,
    coalesce(stddev_pop(speed), 0) AS dev, count(*) FILTER (speed > 30) AS spikes, coalesce(avg(CASE WHEN dt > 0 THEN dist END), 0) AS baseline, coalesce(avg(CASE WHEN dt > 0 THEN height END), 50) AS height,
    sum(CASE WHEN dt > 5 THEN 35 WHEN dt > 2 THEN 15 ELSE 0 END) AS penalty
  FROM measured GROUP BY flight_id
),
lapped AS (SELECT *, greatest(0, least(100, (1 - baseline / (2 * height * tan(radians(42)))) * 100)) AS overlap FROM found),
scores AS (
  SELECT *, greatest(0, least(100, 100.0 - penalty)) AS continuity, greatest(0, least(100, 100 - 3 * dev - 25 * spikes)) AS smoothness,
    CASE WHEN overlap BETWEEN 65 AND 88 THEN 100 WHEN overlap > 88 THEN greatest(75, 100 - (overlap - 88) * 2) ELSE greatest(0, overlap * 1.5) END AS overlap_score
  FROM lapped WHERE fixes >= 2
)"""


@query(f"""
WITH {_TRAJECTORY}, g AS (SELECT *, continuity * 0.5 + smoothness * 0.3 + overlap_score * 0.2 AS gps FROM scores),
o AS (SELECT *, 0.28 * 70 + 0.20 * gps + 0.15 * 65 + 0.12 * 45 + 0.10 * 80 + 0.08 * 75 + 0.07 * 90 AS overall FROM g)
SELECT flight_id, fixes, round_even(overall, 6) AS overall, CASE WHEN overall >= 80 THEN 'HIGH' WHEN overall >= 60 THEN 'MODERATE' ELSE 'LOW' END AS quality, overall >= 40 AS reconstructible,
  round_even(gps, 6) AS gps,
  array_to_string(list_filter([CASE WHEN max_gap > 2 THEN 'GPS_GAP_DETECTED' END, CASE WHEN spikes > 0 THEN 'SPEED_SPIKE_DETECTED' END, CASE WHEN overlap < 55 THEN 'LOW_VIEW_OVERLAP' END, 'HIGH_VIDEO_COMPRESSION', CASE WHEN gps < 50 THEN 'POOR_GPS' END], lambda x: x IS NOT NULL), ',') AS warnings
FROM o""")
def flight_quality_report(spark: SparkSession, d: str) -> DataFrame:
    visual = {k: F.lit(float(v)) for k, v in {"blur": 70, "texture": 65, "compression": 45, "exposure": 80, "shadow": 75, "illumination": 90}.items()}
    found = telemetry.trajectory_quality(view(spark, d, "telemetry"))
    return rounded(telemetry.quality_report(found, visual).withColumn("warnings", F.array_join("warnings", ",")), "overall", "gps")


@query(f"WITH {_TRAJECTORY} SELECT flight_id, fixes, round_even(max_gap, 6) AS max_gap, round_even(max_speed, 6) AS max_speed, round_even(avg_speed, 6) AS avg_speed, round_even(baseline, 6) AS baseline, round_even(height, 6) AS height, round_even(overlap, 6) AS overlap, round_even(continuity, 6) AS continuity, round_even(smoothness, 6) AS smoothness, round_even(overlap_score, 6) AS overlap_score FROM scores")
def trajectory_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = telemetry.trajectory_quality(view(spark, d, "telemetry")).drop("warnings")
    return rounded(found, *[c for c in found.columns if c not in ("flight_id", "fixes")])


@query(f"SELECT flight_id, bool_or(has_rtk) AS has_rtk, count(baro) > 0 AS has_baro, max(t) - min(t) AS duration, CASE WHEN max(t) > min(t) THEN count(*) / greatest(1.0, max(t) - min(t)) ELSE 1.0 END AS rate FROM {sql('telemetry')} GROUP BY flight_id")
def track_summary(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.track_summary(view(spark, d, "telemetry"))


@query(f"""
WITH v AS (SELECT * FROM {sql("telemetry")}), j AS (SELECT flight_id, seq, t, heading, heading - lag(heading) OVER w AS d FROM v WINDOW w AS (PARTITION BY flight_id ORDER BY t, seq))
SELECT flight_id, seq, heading + sum(CASE WHEN d IS NULL OR abs(d) <= 180 THEN 0 ELSE -360 * floor((d + 180) / 360) END) OVER (PARTITION BY flight_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS unwrapped FROM j""")
def heading_unwrap(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.unwrap(view(spark, d, "telemetry"), "heading", ["t", "seq"]).select("flight_id", "seq", "unwrapped")


@query(f"""
WITH v AS (SELECT * FROM {sql("telemetry")}), l AS (SELECT flight_id, seq, t FROM v WHERE event_type = 'purchase'), r AS (SELECT flight_id, t, max(seq) AS fix FROM v WHERE event_type = 'click' GROUP BY ALL)
SELECT l.flight_id, l.seq, r.fix AS prev_fix FROM l ASOF LEFT JOIN r ON l.flight_id = r.flight_id AND l.t >= r.t""")
def asof_previous_fix(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "telemetry")
    left, right = v.filter("event_type = 'purchase'").select("flight_id", "seq", "t"), v.filter("event_type = 'click'").select("flight_id", "t", F.col("seq").alias("fix"))
    return asof_join(left, right, ["flight_id"], "t", "fix").select("flight_id", "seq", F.col("prev.fix").alias("prev_fix"))


@query(f"""
WITH v AS (SELECT * FROM {sql("telemetry")}), l AS (SELECT flight_id, seq, t FROM v WHERE event_type = 'purchase'), r AS (SELECT * FROM v WHERE event_type = 'click'),
b AS (SELECT l.*, r.t AS t0, r.alt AS a0, r.lat AS l0 FROM l ASOF LEFT JOIN r ON l.flight_id = r.flight_id AND l.t >= r.t), a AS (SELECT l.flight_id, l.seq, r.t AS t1, r.alt AS a1, r.lat AS l1 FROM l ASOF LEFT JOIN r ON l.flight_id = r.flight_id AND l.t <= r.t)
SELECT b.flight_id, b.seq, round_even(CASE WHEN t0 IS NULL THEN a1 WHEN t1 IS NULL THEN a0 ELSE a0 + (CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 0 END) * (a1 - a0) END, 6) AS alt,
  round_even(CASE WHEN t0 IS NULL THEN l1 WHEN t1 IS NULL THEN l0 ELSE l0 + (CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 0 END) * (l1 - l0) END, 9) AS lat
FROM b JOIN a USING (flight_id, seq)""")
def telemetry_interpolation(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "telemetry")
    out = telemetry.interpolate(v.filter("event_type = 'purchase'").select("flight_id", "seq", "t"), v.filter("event_type = 'click'"), ["alt", "lat"])
    return out.select("flight_id", "seq", F.bround("alt", 6).alias("alt"), F.bround("lat", 9).alias("lat"))


@query(f"""
WITH v AS (SELECT *, CAST(round_even(t * 30, 0) AS BIGINT) AS frame FROM {sql("telemetry")})
SELECT flight_id, frame, arg_max(seq, seq) AS seq, count(*) AS fixes FROM v GROUP BY flight_id, frame""")
def frame_telemetry_match(spark: SparkSession, d: str) -> DataFrame:
    """Fixes by frame number; of several the last one wins."""
    v = view(spark, d, "telemetry").withColumn("frame", F.rint(F.col("t") * 30).cast("long"))
    return v.groupBy("flight_id", "frame").agg(F.max("seq").alias("seq"), F.count(F.lit(1)).alias("fixes"))


@query(f"""
WITH v AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY t, seq) - 1 AS i FROM {sql("telemetry")}), k AS (SELECT flight_id, i FROM v WHERE has_rtk),
b AS (SELECT v.flight_id, v.seq, v.i, k.i AS p FROM v ASOF LEFT JOIN k ON v.flight_id = k.flight_id AND v.i >= k.i), a AS (SELECT v.flight_id, v.seq, k.i AS n FROM v ASOF LEFT JOIN k ON v.flight_id = k.flight_id AND v.i <= k.i)
SELECT b.flight_id, b.seq, CASE WHEN p IS NULL THEN n WHEN n IS NULL THEN p WHEN i - p <= n - i THEN p ELSE n END AS anchor, round_even(1 + 0.05 * CASE WHEN p IS NULL THEN n - i WHEN n IS NULL THEN i - p ELSE least(i - p, n - i) END, 6) AS growth FROM b JOIN a USING (flight_id, seq)""")
def nearest_anchor(spark: SparkSession, d: str) -> DataFrame:
    """The nearest pose with RTK by index, the earlier on a tie, and how far the drift has grown."""
    w = Window.partitionBy("flight_id").orderBy("t", "seq")
    v = view(spark, d, "telemetry").withColumn("i", F.row_number().over(w) - 1).select("flight_id", "seq", "i", "has_rtk")
    known = v.filter("has_rtk").select("flight_id", "i", F.col("i").alias("anchor"))
    rows = asof_join(v, known, ["flight_id"], "i", "anchor", ("backward", "forward"))
    p, n, i = F.col("prev.anchor"), F.col("next.anchor"), F.col("i")
    nearest = F.when(p.isNull(), n).when(n.isNull(), p).when(i - p <= n - i, p).otherwise(n)
    return rows.select("flight_id", "seq", nearest.cast("long").alias("anchor"), F.bround(1 + 0.05 * F.abs(i - nearest), 6).alias("growth"))


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey AS org FROM customer WHERE c_name ILIKE '%#00000001%' ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 2")
def project_page(spark: SparkSession, d: str) -> DataFrame:
    projects = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("org"), F.col("c_acctbal").alias("created"))
    return relational.page(projects, "#00000001", ["name"], "created", "id", limit=20, offset=2).select("id", "name", "org")


@query("SELECT c_custkey AS id, c_name AS name, count(o_orderkey) AS jobs, count(o_orderkey) FILTER (o_orderstatus = 'F') AS failed, round_even(avg(CAST(o_totalprice AS DOUBLE)), 4) AS mean_confidence FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def project_detail(spark: SparkSession, d: str) -> DataFrame:
    projects = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    jobs = table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("OTHER").alias("status"), F.col("o_totalprice").cast("double").alias("confidence"))
    return rounded(relational.project_detail(projects, jobs), "mean_confidence", digits=4)


@query("SELECT o_orderkey AS flight_id, c_custkey AS project_id, n_nationkey AS org_id FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 AND CASE o_orderstatus WHEN 'O' THEN 4 WHEN 'P' THEN 2 ELSE 1 END >= 2")
def flight_access(spark: SparkSession, d: str) -> DataFrame:
    flights = table(spark, d, "orders").select(F.col("o_orderkey").alias("flight_id"), F.col("o_custkey").alias("project_id"), F.when(F.col("o_orderstatus") == "O", "PROJECT_MANAGER").when(F.col("o_orderstatus") == "P", "ANALYST").otherwise("VIEWER").alias("role"))
    projects = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_nationkey").alias("org_id"))
    orgs = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("org_id"))
    return relational.accessible(flights, projects, orgs, "ANALYST")


@query("SELECT user_id AS job_id, arg_max(event_type, ts) AS stage, arg_max(value, ts) AS progress, max(ts) AS updated_at FROM events GROUP BY user_id")
def latest_progress(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("value").alias("progress"), F.col("ts").alias("updated_at"), "event_id")
    return relational.latest(events, "job_id", ["updated_at", "event_id"]).drop("event_id")


@query("SELECT user_id AS worker, max(ts) AS seen FROM events GROUP BY user_id HAVING max(ts) > (SELECT max(ts) FROM events) - INTERVAL 6 HOUR")
def active_workers(spark: SparkSession, d: str) -> DataFrame:
    beats = table(spark, d, "events").select(F.col("user_id").alias("worker"), "ts")
    return relational.active(beats, "worker", "ts", "6 hours")


@query("SELECT event_id, user_id AS job_id, CASE WHEN event_type IN ('error', 'purchase') THEN 'REFUSED' ELSE 'CANCELLED' END AS outcome, CAST(floor(least(greatest(value, 0), 100) / 100 * 1000) AS BIGINT) AS frames FROM events")
def cancel_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Cancelling is refused in a terminal state; frames done follow from the percentage."""
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "COMPLETED").otherwise("QUEUED")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("job_id"), F.when(status.isin(*rules.TERMINAL), "REFUSED").otherwise("CANCELLED").alias("outcome"), F.floor(rules.clip(F.col("value"), 0.0, 100.0) / 100 * 1000).alias("frames"))


@query("SELECT c.c_custkey AS id FROM customer c JOIN nation n ON n_nationkey = c_nationkey WHERE NOT (n_regionkey = 2)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Projects left after the organisations of a region go."""
    projects = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("org_id"))
    return relational.delete_children(projects, table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("org_id")), "org_id").select("id")


@query("SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'renamed ' || c_custkey END, c_name) AS name FROM customer")
def partial_update(spark: SparkSession, d: str) -> DataFrame:
    projects = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    changes = projects.filter("id % 3 = 0").select("id", F.concat(F.lit("renamed "), F.col("id")).alias("name"))
    return relational.update(projects, changes, "id")


@query("SELECT event_id, round_even(6378137.0 * radians((event_id % 991) * 1e-7) * cos(radians(37.0)), 6) AS e, round_even(6378137.0 * radians((event_id % 997) * 1e-7), 6) AS n FROM events")
def flat_enu(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "events").select("event_id", ((F.col("event_id") % 997) * F.lit(1e-7)).alias("dlat"), ((F.col("event_id") % 991) * F.lit(1e-7)).alias("dlon"))
    zero = F.lit(0.0)
    e, n, _ = geodesy.flat_enu(F.col("dlat"), F.col("dlon"), zero, zero, zero, zero)
    return v.select("event_id", F.bround(e * F.cos(F.radians(F.lit(37.0))), 6).alias("e"), F.bround(n, 6).alias("n"))


@query("SELECT event_id, round_even(37 + (event_id % 997) * 1e-3, 6) AS lat, round_even(-122 + (event_id % 991) * 1e-3, 6) AS lon, round_even(CAST(value AS DOUBLE), 3) AS alt FROM events")
def geodetic_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """To ENU about an origin and back again."""
    v = table(spark, d, "events").select("event_id", (37 + (F.col("event_id") % 997) * F.lit(1e-3)).alias("lat"), (-122 + (F.col("event_id") % 991) * F.lit(1e-3)).alias("lon"), F.col("value").cast("double").alias("alt"))
    origin = (F.lit(37.4), F.lit(-121.6), F.lit(10.0))
    e, n, u = geodesy.enu(F.col("lat"), F.col("lon"), F.col("alt"), *origin)
    v = v.select("event_id", e.alias("e"), n.alias("n"), u.alias("u"))
    lat, lon, alt = geodesy.from_enu(F.col("e"), F.col("n"), F.col("u"), *origin)
    return v.select("event_id", F.bround(lat, 6).alias("lat"), F.bround(lon, 6).alias("lon"), F.bround(alt, 3).alias("alt"))


@query(f"SELECT flight_id, CASE WHEN n = 0 THEN 'VISUAL_ONLY' WHEN n < 0.8 * f THEN 'GPS_DEGRADED' WHEN rtk THEN 'RTK_PPK' ELSE 'GPS_ONLY' END AS mode FROM (SELECT flight_id, count(baro) AS n, count(*) AS f, bool_or(has_rtk) AS rtk FROM {sql('telemetry')} GROUP BY flight_id)")
def positioning_mode(spark: SparkSession, d: str) -> DataFrame:
    g = view(spark, d, "telemetry").groupBy("flight_id").agg(F.count("baro").alias("n"), F.count(F.lit(1)).alias("f"), F.bool_or("has_rtk").alias("rtk"))
    return g.select("flight_id", rules.positioning_mode(F.col("n"), F.col("f"), F.col("rtk"), F.lit(False)).alias("mode"))


@query("SELECT event_id, round_even(CASE WHEN event_type = 'purchase' THEN 0.02 ELSE 2 * coalesce(nullif(event_id % 5, 0), 2.0) END, 6) AS h, round_even(least(70, value / 1000 * 70) + greatest(0, 30 - 3 * greatest(0, event_id % 20 - 5)), 6) AS confidence, round_even(sqrt(1 + 0.25 + 0.09) + greatest(0, event_id % 30 - 15) * 0.05, 6) AS uncertainty FROM events")
def pose_scores(spark: SparkSession, d: str) -> DataFrame:
    """Sigmas of fixes, pose confidence and measurement uncertainty."""
    i = F.col("event_id")
    h, _ = rules.gps_sigma(F.col("event_type") == "purchase", (i % 5).cast("double"), F.lit(None).cast("double"))
    return table(spark, d, "events").select(
        "event_id",
        F.bround(h, 6).alias("h"),
        F.bround(rules.pose_confidence(F.col("value"), (i % 20).cast("double")), 6).alias("confidence"),
        F.bround(rules.uncertainty(F.lit("HIGH"), F.lit("HIGH"), (i % 30).cast("double")), 6).alias("uncertainty"),
    )
