"""Queries over job registries, storage keys, manifests and set operations on clouds and meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.functions import geodesy
from aerolith.operators import frames as fr
from aerolith.operators import jobs, meshes, points, relational
from aerolith.plans.depths import rounded
from aerolith.plans.views import sql, table, view
from aerolith.sinks import manifests
from aerolith.streaming.progress import STATES

QUERIES: dict = {}
ORACLE: dict = {}
OBS, FRAMES, FACES, VERTICES, TEL = (sql(n) for n in ("observations", "frames", "faces", "vertices", "telemetry"))


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 1000000 + s_suppkey, 'new ' || s_name FROM supplier")
def insert_projects(spark: SparkSession, d: str) -> DataFrame:
    projects = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    fresh = table(spark, d, "supplier").select((1000000 + F.col("s_suppkey")).alias("id"), F.concat(F.lit("new "), "s_name").alias("name"))
    return projects.unionByName(fresh)


@query("""
SELECT c.c_custkey AS id, CASE WHEN s.s_suppkey IS NOT NULL AND s.s_nationkey = c.c_nationkey THEN 'ORG_ADMIN' ELSE c.c_mktsegment END AS role
FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey""")
def role_update(spark: SparkSession, d: str) -> DataFrame:
    """Roles of members; a change counts only within the organisation of who asks for it."""
    members = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("org"), F.col("c_mktsegment").alias("role"))
    asked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("asking"), F.lit("ORG_ADMIN").alias("wanted"))
    rows = members.join(asked, "id", "left")
    return rows.select("id", F.when(F.col("asking") == F.col("org"), F.col("wanted")).otherwise(F.col("role")).alias("role"))


@query("SELECT user_id AS job_id, arg_max(event_type, row(ts, event_id)) AS stage FROM events GROUP BY user_id HAVING arg_max(event_type, row(ts, event_id)) <> 'error'")
def progress_after_deletes(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each job; a deletion (here: an error) leaves none."""
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), "ts", "event_id")
    return relational.latest(e, "job_id", ["ts", "event_id"]).filter("stage <> 'error'").select("job_id", "stage")


@query("""
WITH RECURSIVE first AS (SELECT user_id AS key, ts, min(event_id) AS id FROM events GROUP BY user_id, ts),
next AS (SELECT key, ts, first_value(ts) OVER w AS next_ts, first_value(id) OVER w AS next_id FROM first WINDOW w AS (PARTITION BY key ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR FOLLOWING AND UNBOUNDED FOLLOWING)),
held AS (
  SELECT key, min(ts) AS ts, arg_min(id, ts) AS id FROM first GROUP BY key
  UNION ALL SELECT n.key, n.next_ts, n.next_id FROM held h JOIN next n ON n.key = h.key AND n.ts = h.ts WHERE n.next_ts IS NOT NULL
)
SELECT e.user_id AS key, event_id AS id, h.id IS NOT NULL AS granted, last_value(h.id IGNORE NULLS) OVER (PARTITION BY e.user_id ORDER BY e.ts, event_id) AS holder
FROM events e LEFT JOIN held h ON h.key = e.user_id AND h.ts = e.ts AND h.id = e.event_id""")
def job_locks(spark: SparkSession, d: str) -> DataFrame:
    """Every request for the lock of a job: whether it got it, and which request has it then; a lock ends an hour after it was given."""
    asked = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts")
    return jobs.lock_grants(asked).select("key", "id", "granted", "holder")


_MESSAGES = """(SELECT user_id AS key, CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 21600) AS BIGINT) AS id, ts, event_id,
  CASE WHEN event_id % 41 = 0 THEN 'BOGUS' WHEN event_id % 211 = 0 THEN 'FAILED' WHEN event_id % 503 = 0 THEN 'CANCELLED' ELSE ([{stages}])[1 + least(12, date_diff('second', TIMESTAMP '2024-01-01', ts) // 216000 + event_id % 3)] END AS stage FROM events)""".replace("{stages}", ", ".join(f"'{x}'" for x in STATES))


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages to jobs: the events of a user within six hours are deliveries of one message."""
    seconds = F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    i = F.col("event_id")
    place = F.least(F.lit(12), F.floor(seconds / 216000) + i % 3)
    stage = F.when(i % 41 == 0, "BOGUS").when(i % 211 == 0, "FAILED").when(i % 503 == 0, "CANCELLED").otherwise(F.element_at(F.array(*[F.lit(x) for x in STATES]), (1 + place).cast("int")))
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.floor(seconds / 21600).alias("id"), "ts", stage.alias("stage"))


@query(f"""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY key, id ORDER BY ts, stage) > 1 AS again, list_position([{', '.join(f"'{x}'" for x in STATES)}], stage) AS place FROM {_MESSAGES}),
k AS (SELECT *, NOT again AND place IS NOT NULL AS counts, stage IN ('COMPLETED', 'FAILED', 'CANCELLED') AS ends FROM m),
w AS (
  SELECT *, coalesce(max(CASE WHEN counts AND NOT ends THEN place END) OVER before, 1) AS furthest, first_value(CASE WHEN counts AND ends THEN stage END IGNORE NULLS) OVER before AS ended
  FROM k WINDOW before AS (PARTITION BY key ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
r AS (
  SELECT *, coalesce(ended, ([{', '.join(f"'{x}'" for x in STATES)}])[furthest]) AS before,
    CASE WHEN again THEN 'duplicate' WHEN place IS NULL THEN 'unknown' WHEN ended IS NOT NULL THEN 'ended' WHEN NOT ends AND place < furthest THEN 'backward' END AS reason FROM w
)
SELECT key, id, epoch_us(ts) AS at, stage, before, CASE WHEN reason IS NULL THEN stage ELSE before END AS after, reason IS NULL AS accepted, reason FROM r""")
def job_transitions(spark: SparkSession, d: str) -> DataFrame:
    """What each message does to its job: the state before and after, or why it was refused."""
    out = jobs.transitions(messages(spark, d))
    return out.select("key", "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "stage", "before", "after", "accepted", "reason")


@query("""
SELECT o_orderkey AS flight_id, CASE WHEN overall >= 40 THEN 'QUALITY_READY' ELSE 'FAILED' END AS status, '{"codec":"h264","quality":{"overall":' || overall || ',"ok":' || (overall >= 40) || '}}' AS report
FROM (SELECT o_orderkey, CAST(o_custkey % 100 AS INT) AS overall FROM orders)""")
def quality_merge(spark: SparkSession, d: str) -> DataFrame:
    """The quality score merged into a flight's report; below 40 the flight fails."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("flight_id"), F.lit('{"codec":"h264"}').alias("report"), (F.col("o_custkey") % 100).cast("int").alias("overall"))
    ok = F.col("overall") >= 40
    part = F.struct(F.col("overall").alias("overall"), ok.alias("ok"))
    return rows.select("flight_id", F.when(ok, "QUALITY_READY").otherwise("FAILED").alias("status"), manifests.merged("report", "quality", part).alias("report"))


@query("""
WITH n AS (SELECT o_custkey AS job_id, max(o_orderkey) AS asset, count(*) AS assets FROM orders GROUP BY o_custkey)
SELECT coalesce(m.c_custkey, n.job_id) AS job_id, coalesce(n.asset, m.c_nationkey) AS asset, coalesce(n.assets, 0) AS assets, CASE WHEN n.job_id IS NULL THEN 'OPEN' ELSE 'COMPLETED' END AS status
FROM customer m FULL JOIN n ON n.job_id = m.c_custkey""")
def model_registration(spark: SparkSession, d: str) -> DataFrame:
    """Models by job: updated where a job has delivered assets, inserted where there was none."""
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_nationkey").alias("old"))
    fresh = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg(F.max("o_orderkey").alias("new"), F.count(F.lit(1)).alias("n"))
    rows = known.join(fresh, "job_id", "full")
    status = F.when(F.col("new").isNull(), "OPEN").otherwise("COMPLETED")
    return rows.select("job_id", F.coalesce("new", "old").alias("asset"), F.coalesce("n", F.lit(0)).alias("assets"), status.alias("status"))


_KEY = "printf('jobs/%d/interim/depth/depth_%05d.png', o_custkey, o_orderkey % 100000)"


@query(f"SELECT o_orderkey, {_KEY} AS key FROM orders WHERE starts_with({_KEY}, 'jobs/1')")
def storage_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of depth maps, those of a prefix."""
    key = manifests.storage_key(F.col("o_custkey"), "depth", "depth", F.col("o_orderkey") % 100000, "png")
    return table(spark, d, "orders").select("o_orderkey", key.alias("key")).filter(F.startswith("key", F.lit("jobs/1")))


@query(f"WITH a AS (SELECT x, y, z FROM {OBS} WHERE frame % 2 = 0), b AS (SELECT x, y, z FROM {OBS} WHERE frame % 2 = 1) SELECT count(*) AS n, CAST(sum(x) AS DOUBLE) AS x, CAST(sum(z) AS DOUBLE) AS z FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def joined_clouds(spark: SparkSession, d: str) -> DataFrame:
    """The clouds of all frames as one."""
    o = view(spark, d, "observations")
    both = o.filter("frame % 2 = 0").select("x", "y", "z").unionByName(o.filter("frame % 2 = 1").select("x", "y", "z"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("z").alias("z"))


@query(f"SELECT fid, i0, i1, i2, false AS inferred FROM {FACES} UNION ALL SELECT -1 - fid, i0, i2, i1, true FROM {FACES} WHERE i0 % 50 = 0")
def faces_with_inferred(spark: SparkSession, d: str) -> DataFrame:
    f = view(spark, d, "faces")
    extra = f.filter("i0 % 50 = 0").select((-1 - F.col("fid")).alias("fid"), "i0", F.col("i2").alias("i1"), F.col("i1").alias("i2"), F.lit(True).alias("inferred"))
    return f.select("fid", "i0", "i1", "i2", F.lit(False).alias("inferred")).unionByName(extra)


@query(f"SELECT l_orderkey AS track FROM {OBS} WHERE conf_pct >= 60 EXCEPT SELECT l_orderkey FROM {OBS} WHERE conf_pct < 40")
def static_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Tracks seen at rest that never moved."""
    o = view(spark, d, "observations").withColumnRenamed("l_orderkey", "track")
    return o.filter("conf_pct >= 60").select("track").subtract(o.filter("conf_pct < 40").select("track"))


@query(f"""
WITH f AS (SELECT fid % 4 AS part, * FROM {FACES}), u AS (SELECT DISTINCT part, vid FROM (SELECT part, i0 AS vid FROM f UNION ALL SELECT part, i1 FROM f UNION ALL SELECT part, i2 FROM f)),
n AS (SELECT part, vid, row_number() OVER (PARTITION BY part ORDER BY vid) - 1 AS i FROM u)
SELECT f.part, f.fid, a.i AS i0, b.i AS i1, c.i AS i2 FROM f JOIN n a ON a.part = f.part AND a.vid = i0 JOIN n b ON b.part = f.part AND b.vid = i1 JOIN n c ON c.part = f.part AND c.vid = i2""")
def reindexed_parts(spark: SparkSession, d: str) -> DataFrame:
    """The faces of each part with indices into the vertices that it uses."""
    f = view(spark, d, "faces").withColumn("part", F.col("fid") % 4)
    return meshes.reindexed(f, "part")[1].select("part", "fid", "i0", "i1", "i2")


@query(f"""
WITH e AS (SELECT DISTINCT least(p, q) AS a, greatest(p, q) AS b FROM (SELECT i0 AS p, i1 AS q FROM {FACES} UNION ALL SELECT i1, i2 FROM {FACES} UNION ALL SELECT i2, i0 FROM {FACES}) WHERE p <> q)
SELECT a, b, round_even(sqrt(pow(s.x - t.x, 2) + pow(s.y - t.y, 2) + pow(s.z - t.z, 2)), 6) AS length FROM e JOIN {VERTICES} s ON s.vid = a JOIN {VERTICES} t ON t.vid = b ORDER BY length, a, b""")
def edges_by_length(spark: SparkSession, d: str) -> DataFrame:
    """Edges, the shortest first."""
    return rounded(meshes.edge_lengths(view(spark, d, "faces"), view(spark, d, "vertices")), "length").orderBy("length", "a", "b")


@query(f"""
WITH b AS (SELECT min(x) AS x0, min(y) AS y0, greatest(1e-4, max(x) - min(x)) AS dx, greatest(1e-4, max(y) - min(y)) AS dy FROM {VERTICES}), c AS (SELECT fid, 0 AS corner, i0 AS vid FROM {FACES} UNION ALL SELECT fid, 1, i1 FROM {FACES} UNION ALL SELECT fid, 2, i2 FROM {FACES})
SELECT fid, corner, round_even((x - x0) / dx, 6) AS u, round_even((y - y0) / dy, 6) AS v FROM c JOIN {VERTICES} USING (vid), b""")
def planar_uv(spark: SparkSession, d: str) -> DataFrame:
    return rounded(meshes.planar_uv(view(spark, d, "faces"), view(spark, d, "vertices")), "u", "v")


@query(f"SELECT count(*) AS input, count(*) FILTER (keep) AS output, count(*) FILTER (NOT keep) AS removed, round_even(100.0 * count(*) FILTER (keep) / count(*), 6) AS retained FROM (SELECT NOT (x BETWEEN 10 AND 20 AND y BETWEEN 0 AND 5 AND z BETWEEN 0 AND 50) AND cls NOT IN (5, 6) AS keep FROM {OBS})")
def filter_report(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "observations")
    return rounded(points.filter_report(o, points.outside_boxes(o, [(10, 0, 0, 20, 5, 50)], [5, 6])), "retained")


_CAMERAS = "(SELECT s_suppkey AS id, CAST(s_suppkey * 7 % 50 AS DOUBLE) AS x, CAST(s_suppkey * 3 % 11 AS DOUBLE) AS y, CAST(40 + s_suppkey * 5 % 60 AS DOUBLE) AS z FROM supplier)"


@query(f"""
WITH p AS (SELECT DISTINCT x, y, z FROM {OBS}), d AS (SELECT p.x, p.y, p.z, arg_min(c.id, row(pow(p.x - c.x, 2) + pow(p.y - c.y, 2) + pow(p.z - c.z, 2), c.id)) AS camera, min(sqrt(pow(p.x - c.x, 2) + pow(p.y - c.y, 2) + pow(p.z - c.z, 2))) AS dist, arg_min(c.z, row(pow(p.x - c.x, 2) + pow(p.y - c.y, 2) + pow(p.z - c.z, 2), c.id)) AS cz FROM p, {_CAMERAS} c GROUP BY ALL)
SELECT x, y, z, camera, round_even(dist, 6) AS dist, cz - z < 0 AS turned FROM d""")
def nearest_camera(spark: SparkSession, d: str) -> DataFrame:
    """The camera nearest to each place of a cloud, and whether an upward normal must be turned towards it."""
    i = F.col("s_suppkey")
    place = [(i * 7 % 50).cast("double").alias("x"), (i * 3 % 11).cast("double").alias("y"), (40 + i * 5 % 60).cast("double").alias("z")]
    cameras = table(spark, d, "supplier").select(i.alias("id"), *place)
    near = points.nearest_other(view(spark, d, "observations"), cameras, 8.0)
    rows = near.join(cameras.select("id", F.col("z").alias("cz")), "id")
    return rows.select("x", "y", "z", F.col("id").alias("camera"), F.bround("d", 6).alias("dist"), (F.col("cz") - F.col("z") < 0).alias("turned"))


@query(f"""
WITH s AS (SELECT job_id, frame_index, frame_index - lag(frame_index) OVER (PARTITION BY job_id ORDER BY frame_index) AS gap FROM {FRAMES} WHERE blur > 40), t AS (SELECT job_id, count(*) AS frames FROM {FRAMES} GROUP BY job_id)
SELECT job_id, any_value(frames) AS frames, count(*) AS keyframes, round_even(100.0 * count(*) / any_value(frames), 4) AS percent, round_even(avg(gap / 30.0), 4) AS interval, count(*) FILTER (frame_index % 5 = 0) AS recovered
FROM s JOIN t USING (job_id) GROUP BY job_id""")
def keyframe_summary(spark: SparkSession, d: str) -> DataFrame:
    """Keyframes of each job (here: the sharp frames), their share, the mean time between them, and how many were recovered."""
    f = view(spark, d, "frames")
    gap = F.col("frame_index") - F.lag("frame_index").over(Window.partitionBy("job_id").orderBy("frame_index"))
    keys = f.filter("blur > 40").withColumn("elapsed", gap / 30.0).withColumn("recovered", F.col("frame_index") % 5 == 0)
    return rounded(fr.keyframe_summary(keys, f), "percent", "interval", digits=4).select("job_id", "frames", "keyframes", "percent", "interval", "recovered")


@query(f"""
WITH m AS (SELECT a.job_id, a.frame_index AS a, b.frame_index AS b, (a.frame_index * 7 + b.frame_index) % 100 AS inliers FROM {FRAMES} a JOIN {FRAMES} b ON a.job_id = b.job_id AND b.frame_index BETWEEN a.frame_index + 1 AND a.frame_index + 2),
w AS (SELECT m.*, CASE WHEN inliers >= 20 THEN inliers END AS found FROM m)
SELECT job_id, count(*) AS pairs, count(found) AS valid, CAST(sum(coalesce(found, 0)) AS BIGINT) AS inliers FROM w GROUP BY job_id""")
def pair_records(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of frames with their matches; a pair without enough counts as an empty, invalid record."""
    pairs = fr.pairs(view(spark, d, "frames"), 1)
    score = (F.col("a") * 7 + F.col("b")) % 100
    matched = pairs.select("job_id", "a", "b", score.alias("found")).filter("found >= 20")
    rows = pairs.join(matched, ["job_id", "a", "b"], "left").withColumn("inliers", F.coalesce("found", F.lit(0)))
    return rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("found").isNotNull()).alias("valid"), F.sum("inliers").alias("inliers"))


@query("""
SELECT event_id, round_even(radians(-122 + (event_id % 991) * 1e-3), 9) AS west, round_even(radians(37 + (event_id % 997) * 1e-3), 9) AS south, true AS ordered FROM events""")
def tile_regions(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of east, north, up about an origin as regions in radians; the lower corner is the origin itself."""
    i = F.col("event_id")
    zero = F.lit(0.0)
    west, south, east, north, low, high = geodesy.region([zero] * 3, [(i % 50 + 1).cast("double"), (i % 40 + 1).cast("double"), (i % 30).cast("double")], 37 + (i % 997) * F.lit(1e-3), -122 + (i % 991) * F.lit(1e-3), zero)
    ordered = (west < east) & (south < north) & (low <= high)
    return table(spark, d, "events").select("event_id", F.bround(west, 9).alias("west"), F.bround(south, 9).alias("south"), ordered.alias("ordered"))


@query("""
SELECT user_id AS job_id, '{"job_id":' || user_id || ',"total_cameras":' || count(*) || ',"cameras":[' || string_agg('{"frame_index":' || event_id || ',"confidence":' || CAST(event_id % 100 AS INT) || '}', ',' ORDER BY event_id) || ']}' AS document
FROM events GROUP BY user_id""")
def cameras_json(spark: SparkSession, d: str) -> DataFrame:
    """A document with the cameras of each job in order."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.struct(F.col("event_id").alias("frame_index"), (F.col("event_id") % 100).cast("int").alias("confidence")).alias("camera"))
    return manifests.cameras(rows, "job_id", "frame_index")


@query("""
WITH t AS (SELECT l_suppkey % 25 AS job_id, l_linenumber AS tile, count(*) AS faces FROM lineitem GROUP BY ALL)
SELECT job_id, '{"asset":{"version":"1.1"},"geometricError":64.0,"root":{"content":{"uri":"tile_root.glb"},"geometricError":48.0,"refine":"REPLACE","children":[' ||
  string_agg('{"content":{"uri":"tile_' || tile || '.glb"},"geometricError":12.0,"faces":' || faces || '}', ',' ORDER BY tile) || ']}}' AS document FROM t GROUP BY job_id""")
def tileset_json(spark: SparkSession, d: str) -> DataFrame:
    """The tree of tiles of each job: a root and its children."""
    tiles = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 25).alias("job_id"), F.col("l_linenumber").alias("tile")).agg(F.count(F.lit(1)).alias("faces"))
    return manifests.tileset(tiles, "job_id")


@query("""
SELECT o_custkey AS job_id, count(*) AS files, CAST(sum(length(o_orderpriority)) AS BIGINT) AS bytes, sha256(string_agg(sha256(o_orderpriority), '' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY o_custkey""")
def export_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Files of each job's export, their bytes, and a digest of their SHA-256 in order."""
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("place"), F.col("o_orderpriority").cast("binary").alias("content"))
    return manifests.manifest(files, "job_id", "place")
