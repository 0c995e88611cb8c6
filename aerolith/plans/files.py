"""Queries over sources, exports and event windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions import rules
from aerolith.plans.views import sql, table, view
from aerolith.operators import meshes, scratch
from aerolith.sinks import exports
from aerolith.sources import point_files
from aerolith.sources import telemetry_files as tf
from aerolith.streaming import progress

QUERIES: dict = {}
ORACLE: dict = {}
TEL = sql("telemetry")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


_SIZES = "min(lat) AS lat0, max(lat) AS lat1, sum(seq) AS seqs, count(*) AS fixes"


@query(f"SELECT flight_id, count(*) AS fixes, round_even(min(alt), 3) AS low, round_even(max(alt), 3) AS high, count(*) FILTER (seq % 3 = 0) AS rtk FROM {TEL} GROUP BY flight_id")
def srt_source(spark: SparkSession, d: str) -> DataFrame:
    """Subtitles written from the fixes of each flight, read back."""
    v = view(spark, d, "telemetry")
    block = F.concat(
        F.col("seq"), F.lit("\n00:00:01,500 --> 00:00:02,000\n[latitude: "), F.format_string("%.7f", "lat"), F.lit("] [longitude: "), F.format_string("%.7f", "lon"), F.lit("] [altitude: "), F.format_string("%.3f", "alt"), F.lit("]"),
        F.when(F.col("seq") % 3 == 0, " [rtk_flag: 1]").otherwise(""),
    )
    files = v.groupBy("flight_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("content"))
    return tf.read_srt(files).groupBy("flight_id").agg(F.count(F.lit(1)).alias("fixes"), F.bround(F.min("alt"), 3).alias("low"), F.bround(F.max("alt"), 3).alias("high"), F.count_if("has_rtk").alias("rtk"))


@query(f"SELECT flight_id, seq, lat, round_even(alt, 6) AS alt, baro, has_rtk FROM {TEL} WHERE seq % 5 <> 0")
def csv_source(spark: SparkSession, d: str) -> DataFrame:
    """Text columns under other names, with rows that don't parse."""
    v = view(spark, d, "telemetry")
    raw = v.select("flight_id", F.when(F.col("seq") % 5 == 0, "bad").otherwise(F.col("lat").cast("string")).alias("GPS_Lat"), F.col("lon").cast("string").alias("lng"), F.col("alt").cast("string").alias("altitude"), F.col("baro").cast("string").alias("barometer"), F.when(F.col("has_rtk"), "FIXED").alias("rtk"), F.col("seq").cast("string").alias("time"))
    return tf.csv_rows(raw).select("flight_id", F.col("t").cast("long").alias("seq"), "lat", F.bround("alt", 6).alias("alt"), "baro", "has_rtk")


@query(f"SELECT flight_id, seq, lat, lon, alt FROM {TEL}")
def json_source(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "telemetry").select("flight_id", F.struct(F.col("lat"), F.col("lon").alias("lng"), F.col("alt").alias("altitude"), F.col("seq").cast("double").alias("timestamp")).alias("p"))
    files = v.groupBy("flight_id").agg(F.to_json(F.struct(F.collect_list("p").alias("records"))).alias("content"))
    return tf.read_json(files).select("flight_id", F.col("t").cast("long").alias("seq"), "lat", "lon", "alt")


@query(f"SELECT seq, CASE WHEN alt > 90 THEN 'alt,' ELSE '' END || CASE WHEN heading >= 300 THEN 'heading' ELSE '' END AS reasons FROM {TEL} WHERE alt > 90 OR heading >= 300")
def contract_rejects(spark: SparkSession, d: str) -> DataFrame:
    _, bad = tf.validate(view(spark, d, "telemetry"), {"alt,": F.col("alt") <= 90, "heading": F.col("heading") < 300})
    return bad.select("seq", F.array_join("reasons", "").alias("reasons"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' ELSE 'abcd' END AS codec, CASE WHEN o_orderkey * 1000 > 104857600 THEN CAST(ceil(o_orderkey * 1000 / 52428800) AS INT) ELSE 1 END AS parts, regexp_replace(o_clerk_, '[^A-Za-z0-9._-]', '_', 'g') AS name FROM (SELECT o_orderkey, 'a b#' || o_orderkey || '.mp4' AS o_clerk_ FROM orders)")
def upload_plan(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    number = lambda s: sum(ord(c) << 8 * k for k, c in enumerate(s))
    code = F.when(F.col("o_orderkey") % 3 == 0, number("avc1")).when(F.col("o_orderkey") % 3 == 1, number("hvc1")).otherwise(number("abcd"))
    return o.select("o_orderkey", rules.codec_name(code).alias("codec"), rules.upload_parts(F.col("o_orderkey") * 1000).alias("parts"), rules.safe_name(F.concat(F.lit("a b#"), F.col("o_orderkey"), F.lit(".mp4"))).alias("name"))


@query("SELECT c_custkey AS id, CAST(unnest(list_transform(range(15), lambda i: floor(i * (c_custkey + 14) / 14))) AS BIGINT) AS frame FROM customer")
def sampled_frames(spark: SparkSession, d: str) -> DataFrame:
    """15 frames spread over videos of custkey + 15 frames."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return c.select("id", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("i")).select("id", F.floor(F.col("i") * (F.col("id") + 14) / 14).alias("frame"))


@query(f"SELECT flight_id, 'SRID=4326;POLYGON((' || x0 || ' ' || y0 || ', ' || x1 || ' ' || y0 || ', ' || x1 || ' ' || y1 || ', ' || x0 || ' ' || y1 || ', ' || x0 || ' ' || y0 || '))' AS wkt FROM (SELECT flight_id, min(seq) AS x0, min(seq % 90) AS y0, max(seq) AS x1, max(seq % 90) AS y1 FROM {TEL} GROUP BY flight_id)")
def extent_wkt(spark: SparkSession, d: str) -> DataFrame:
    g = view(spark, d, "telemetry").groupBy("flight_id").agg(F.min("seq").alias("x0"), F.min(F.col("seq") % 90).alias("y0"), F.max("seq").alias("x1"), F.max(F.col("seq") % 90).alias("y1"))
    return g.select("flight_id", exports.box_wkt(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("wkt"))


@query(f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY t, seq) AS k FROM {TEL})
SELECT flight_id, 0 AS k, 'LineString' AS kind, round_even(min(lon), 7) AS a, round_even(max(lat), 7) AS b, count(*)::DOUBLE AS c FROM o GROUP BY flight_id
UNION ALL SELECT flight_id, k, 'Point', round_even(lon, 7), round_even(lat, 7), round_even(alt, 4) FROM o""")
def geojson_export(spark: SparkSession, d: str) -> DataFrame:
    """Documents parsed again: of the line its western and northern end by the box and its length, of each point its place."""
    schema = "struct<bbox:array<double>,features:array<struct<geometry:struct<type:string,coordinates:string>>>>"
    p = exports.geojson(view(spark, d, "telemetry")).select("flight_id", F.from_json("document", schema).alias("p"))
    p = p.select("flight_id", "p.bbox", F.posexplode("p.features").alias("k", "f")).withColumn("kind", F.col("f.geometry.type"))
    place, line = F.from_json("f.geometry.coordinates", "array<double>"), F.from_json("f.geometry.coordinates", "array<array<double>>")
    is_line = F.col("kind") == "LineString"
    value = lambda of_line, i: F.when(is_line, of_line).otherwise(F.get(place, i))
    a, b, c = value(F.col("bbox")[0], 0), value(F.col("bbox")[3], 1), value(F.size(line).cast("double"), 2)
    return p.select("flight_id", "k", "kind", F.bround(a, 7).alias("a"), F.bround(b, 7).alias("b"), F.bround(c, 4).alias("c"))


@query(f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY t, seq) + 1 AS k FROM {TEL})
SELECT flight_id, 0 AS k, 'document' AS id, NULL::DOUBLE AS lon, NULL::DOUBLE AS alt, 0 AS numbers FROM o GROUP BY flight_id
UNION ALL SELECT flight_id, 1, flight_id || '_path', NULL, NULL, 3 * count(*) FROM o GROUP BY flight_id
UNION ALL SELECT flight_id, k, flight_id || '_cam_' || lpad(seq::VARCHAR, 5, '0'), round_even(lon, 7), round_even(alt, 4), 3 FROM o""")
def czml_export(spark: SparkSession, d: str) -> DataFrame:
    """Documents parsed again: header, path and a packet for each fix."""
    degrees = "struct<cartographicDegrees:array<double>>"
    p = exports.czml(view(spark, d, "telemetry")).select("flight_id", F.from_json("document", f"array<struct<id:string,polyline:struct<positions:{degrees}>,position:{degrees}>>").alias("p"))
    p = p.select("flight_id", F.posexplode("p").alias("k", "x")).withColumn("at", F.col("x.position.cartographicDegrees"))
    numbers = F.when(F.col("at").isNotNull(), F.size("at")).when(F.col("x.polyline").isNotNull(), F.size("x.polyline.positions.cartographicDegrees")).otherwise(0)
    return p.select("flight_id", "k", "x.id", F.bround(F.get("at", 0), 7).alias("lon"), F.bround(F.get("at", 2), 4).alias("alt"), numbers.alias("numbers"))


_F, _V = sql("faces"), sql("vertices")


@query(f"""
WITH c AS (SELECT f.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM {_F} f JOIN {_V} a ON a.vid = i0 JOIN {_V} b ON b.vid = i1 JOIN {_V} c ON c.vid = i2),
n AS (SELECT *, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz FROM c),
s AS (SELECT vid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM (SELECT i0 AS vid, nx, ny, nz FROM n UNION ALL SELECT i1, nx, ny, nz FROM n UNION ALL SELECT i2, nx, ny, nz FROM n) GROUP BY vid),
l AS (SELECT v.vid, nx, ny, nz, sqrt(nx * nx + ny * ny + nz * nz) AS size FROM {_V} v LEFT JOIN s USING (vid)),
b AS (SELECT min(x) AS x0, min(y) AS y0, greatest(1e-4, max(x) - min(x)) AS dx, greatest(1e-4, max(y) - min(y)) AS dy FROM {_V})
SELECT 0 AS part, unnest(['mtllib model.mtl', 'usemtl DefaultMaterial']) AS line UNION ALL SELECT 1, printf('v %.6f %.6f %.6f', x, y, z) FROM {_V}
UNION ALL SELECT 2, CASE WHEN size > 0 THEN printf('vn %.6f %.6f %.6f', nx / size + 0.0, ny / size + 0.0, nz / size + 0.0) ELSE 'vn 0.000000 0.000000 1.000000' END FROM l
UNION ALL SELECT 3, printf('vt %.6f %.6f', (x - x0) / dx, (y - y0) / dy) FROM {_V}, b
UNION ALL SELECT 4, printf('f %d/%d/%d %d/%d/%d %d/%d/%d', i0 + 1, i0 + 1, i0 + 1, i1 + 1, i1 + 1, i1 + 1, i2 + 1, i2 + 1, i2 + 1) FROM {_F}""")
def obj_export(spark: SparkSession, d: str) -> DataFrame:
    f, v = view(spark, d, "faces"), view(spark, d, "vertices")
    return exports.obj_lines(v, f, meshes.vertex_normals(f, v), meshes.vertex_uv(v)).select("place.part", "line")


@query(f"SELECT l_orderkey, CAST(round_even((x - 1) / 0.001, 0) AS INT) AS x, CAST(round_even(conf_pct / 100 * 65535, 0) AS INT) AS intensity, [1, 6, 11, 2, 5, 13, 14, 17, 9, 1, 1][cls + 1] AS code, (l_orderkey % 256)::INT << 8 AS r, CAST(least(65535, round_even(z * 1000, 0)) AS INT) AS depth FROM {sql('observations')}")
def las_records(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "observations").select("l_orderkey", "x", "y", "z", "cls", (F.col("conf_pct") / 100).alias("conf"), F.lit(1).alias("state"), *[(F.col("l_orderkey") % 256).alias(c) for c in ("r", "g", "b")], exports.quantised(F.col("z")).alias("depth"))
    return exports.las_columns(o, ("l_orderkey", "depth")).select("l_orderkey", "x", "intensity", "code", "r", "depth")


@query(f"""
SELECT x, y, z, round_even(round_even(conf_pct / 100 * 65535, 0) / 65535.0, 6) AS conf, [1, 6, 11, 2, 5, 13, 14, 17, 9, 1, 1][cls + 1] AS code, CAST(l_linenumber % 6 AS INT) AS state, CAST(l_orderkey % 256 AS INT) AS r FROM {sql('observations')}""")
def las_files(spark: SparkSession, d: str) -> DataFrame:
    """The points of the cloud as they come back from LAS files."""
    spark.dataSource.register(point_files.PointFiles)
    colours = [(F.col("l_orderkey") % k).cast("int").alias(c) for c, k in (("r", 256), ("g", 100), ("b", 10))]
    cloud = view(spark, d, "observations").select("x", "y", "z", (F.col("conf_pct") / 100).alias("conf"), "cls", (F.col("l_linenumber") % 6).cast("int").alias("state"), *colours)
    path = f"{scratch.shared_dir(spark)}/las-{uuid.uuid4().hex}"
    cloud.write.format("points").option("kind", "las").mode("append").save(path)
    read = spark.read.format("points").load(path)
    return read.select(*[F.bround(c, 3).alias(c) for c in ("x", "y", "z")], F.bround("conf", 6).alias("conf"), "code", "state", "r")


@query("""
WITH u AS (SELECT o_orderkey, o_orderkey % 5 AS k, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'Flight ' || o_orderkey || ['.MP4', '.mov', '.csv', '.exe', ''][o_orderkey % 5 + 1] END AS name, ['VIDEO', 'TELEMETRY', 'IMAGE'][o_custkey % 3 + 1] AS kind, CAST(floor(o_totalprice) AS BIGINT) * 400000 - 100000 AS size FROM orders)
SELECT o_orderkey, CASE WHEN kind = 'IMAGE' THEN 'kind' WHEN name = '' THEN 'name' WHEN NOT (kind = 'VIDEO' AND k IN (0, 1) OR kind = 'TELEMETRY' AND k = 2) THEN 'extension' WHEN size <= 0 THEN 'empty'
  WHEN size > CASE kind WHEN 'VIDEO' THEN 53687091200 ELSE 524288000 END THEN 'size' END AS problem FROM u""")
def upload_checks(spark: SparkSession, d: str) -> DataFrame:
    """Which uploads are refused, and why."""
    i = F.col("o_orderkey")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    name = F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("Flight "), i, pick((".MP4", ".mov", ".csv", ".exe", ""), i % 5)))
    rows = table(spark, d, "orders").select(i, name.alias("name"), pick(("VIDEO", "TELEMETRY", "IMAGE"), F.col("o_custkey") % 3).alias("kind"), (F.floor("o_totalprice") * 400_000 - 100_000).alias("size"))
    return rows.select("o_orderkey", rules.upload_problem(F.col("name"), F.col("kind"), F.col("size")).alias("problem"))


@query("""
SELECT event_id, CASE WHEN event_id % 7 > 0 THEN CAST(user_id AS VARCHAR) END AS job_id, CASE WHEN event_id % 7 = 0 OR event_id % 3 = 1 THEN '' ELSE event_type END AS stage,
  CASE WHEN event_id % 7 > 0 THEN (event_id % 100)::DOUBLE ELSE 0.0 END AS progress, CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 1000 END AS frames_total,
  CASE WHEN event_id % 7 = 0 THEN 0.0 WHEN event_id % 3 = 0 THEN (event_id % 50)::DOUBLE + 0.5 WHEN event_id % 3 = 1 THEN (event_id % 90)::DOUBLE + 0.25 ELSE 0.0 END AS gpu_utilization,
  CASE WHEN event_id % 7 > 0 AND event_id % 3 = 1 THEN 1 ELSE 0 END AS warnings, CASE WHEN event_id % 7 = 0 THEN 'event ' || event_id END AS raw FROM events""")
def normalised_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of jobs as they come: some under older names, some without a stage, some that aren't JSON."""
    i = F.col("event_id")
    head = F.format_string('{"job_id": "%d", "progress": %d', F.col("user_id"), i % 100)
    nested = F.format_string('%s, "stage": "%s", "total_frames": %d, "gpu_stats": {"utilization": %d.5, "vram_used": 1.0}}', head, F.col("event_type"), i % 1000, i % 50)
    flat = F.format_string('%s, "frames_total": %d, "gpu_utilization": %d.25, "warnings": ["GPS_GAP"]}', head, i % 1000, i % 90)
    plain = F.format_string('%s, "stage": "%s", "frames_total": %d}', head, F.col("event_type"), i % 1000)
    raw = F.when(i % 7 == 0, F.concat(F.lit("event "), i)).when(i % 3 == 0, nested).when(i % 3 == 1, flat).otherwise(plain)
    e = F.col("e")
    rows = table(spark, d, "events").select(i, progress.normalise(raw).alias("e"))
    return rows.select("event_id", e["job_id"].alias("job_id"), e["stage"].alias("stage"), e["progress"].alias("progress"), e["frames_total"].alias("frames_total"), e["gpu_utilization"].alias("gpu_utilization"), F.size(e["warnings"]).alias("warnings"), e["raw"].alias("raw"))


def _beats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("value").alias("progress"), F.col("ts").cast("timestamp").alias("ts"))


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start_s, event_type AS stage, count(*) AS n, max(value) AS progress FROM events GROUP BY ALL")
def hourly_progress(spark: SparkSession, d: str) -> DataFrame:
    return progress.tumbling(_beats(spark, d), "1 hour").select(F.unix_timestamp("start").alias("start_s"), "stage", "n", "progress")


@query("SELECT user_id AS job_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS beats FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s")
def heartbeat_sessions(spark: SparkSession, d: str) -> DataFrame:
    return progress.sessions(_beats(spark, d), "6 hours").select("job_id", F.unix_timestamp("start").alias("start_s"), "beats")
