"""Queries over points, rasters, frames, meshes and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.functions import geodesy, rules
from aerolith.operators import frames as fr
from aerolith.operators import alignment, meshes, points, rasters, tracks
from aerolith.plans.views import sql, table, view

QUERIES: dict = {}
ORACLE: dict = {}
OBS = sql("observations")
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _observations(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "observations")


@query(f"""
WITH o AS (SELECT *, greatest(1, conf_pct) AS w, floor(x * 0.1) AS vx, floor(y * 0.1) AS vy, floor(z * 0.1) AS vz FROM {OBS}),
c AS (SELECT vx, vy, vz, cls, sum(w) AS w FROM o GROUP BY ALL), m AS (SELECT vx, vy, vz, arg_max(cls, w * 1000 - cls) AS cls FROM c GROUP BY ALL)
SELECT CAST(o.vx AS BIGINT) AS vx, CAST(o.vy AS BIGINT) AS vy, CAST(o.vz AS BIGINT) AS vz, round_even(sum(w * x) / sum(w), 6) AS x, round_even(sum(w * y) / sum(w), 6) AS y, round_even(sum(w * z) / sum(w), 6) AS z,
  max(conf_pct) AS conf_pct, any_value(m.cls) AS cls, count(DISTINCT frame) AS views
FROM o JOIN m ON m.vx = o.vx AND m.vy = o.vy AND m.vz = o.vz GROUP BY o.vx, o.vy, o.vz HAVING count(DISTINCT frame) > 1 OR max(conf_pct) >= 60""")
def voxel_fusion(spark: SparkSession, d: str) -> DataFrame:
    out = points.fuse(_observations(spark, d), 10.0)
    return out.withColumns({c: F.bround(c, 6) for c in ("x", "y", "z")})


@query(f"SELECT arg_min(x, k) AS x, arg_min(y, k) AS y, arg_min(z, k) AS z, arg_min(cls, k) AS cls FROM (SELECT *, row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM {OBS}) GROUP BY floor(x * 0.2), floor(y * 0.2), floor(z * 0.2)")
def voxel_down_sample(spark: SparkSession, d: str) -> DataFrame:
    return points.down_sample(_observations(spark, d), 5.0, KEY).select("x", "y", "z", "cls")


@query(f"SELECT count(*) AS input, count(DISTINCT (floor(x * 0.1), floor(y * 0.1), floor(z * 0.1))) AS fused FROM {OBS}")
def compression(spark: SparkSession, d: str) -> DataFrame:
    o = _observations(spark, d)
    return o.agg(F.count(F.lit(1)).alias("input")).crossJoin(o.select(*[points.cell(c, 10.0).alias(c) for c in ("x", "y", "z")]).distinct().agg(F.count(F.lit(1)).alias("fused")))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even((x - 25) * z / 500, 6) AS cx, round_even((y - 5) * z / 500, 6) AS cy FROM {OBS} WHERE z BETWEEN 1 AND 80 AND x % 2 = 0")
def unproject(spark: SparkSession, d: str) -> DataFrame:
    """Pixels on the stride grid with a depth in range, in camera coordinates."""
    o = _observations(spark, d).filter(F.col("z").between(1, 80) & (F.col("x") % 2 == 0) & ~F.isnan("z"))
    cx, cy, _ = geodesy.unproject(F.col("x"), F.col("y"), F.col("z"), 500.0, 500.0, 25.0, 5.0)
    return o.select(*KEY, F.bround(cx, 6).alias("cx"), F.bround(cy, 6).alias("cy"))


@query(f"""
WITH o AS (SELECT * FROM {OBS}), c AS (SELECT x, y, z, count(*) AS n FROM o GROUP BY ALL), s AS (SELECT CAST(range - 3 AS DOUBLE) AS i FROM range(7)),
ball AS (SELECT a.i AS dx, b.i AS dy, c.i AS dz FROM s a, s b, s c WHERE a.i * a.i + b.i * b.i + c.i * c.i <= 9),
g AS (SELECT x, y, z, x + dx AS gx, y + dy AS gy, z + dz AS gz FROM c CROSS JOIN ball),
near AS (SELECT g.x, g.y, g.z, sum(c.n) - 1 AS n FROM g JOIN c ON c.x = gx AND c.y = gy AND c.z = gz GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(n AS BIGINT) AS neighbours FROM o JOIN near USING (x, y, z) WHERE n >= 2""")
def radius_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Every observation with two others within 3."""
    return points.radius_inliers(_observations(spark, d), 3.0, 2).select(*KEY, "neighbours")


@query()
def statistical_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Every observation near its five nearest others; compared with brute force in the tests."""
    return points.statistical_inliers(_observations(spark, d), 5, 1.0, 2.0).select(*KEY, F.bround("mean_d", 6).alias("mean_d"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {OBS} WHERE NOT (x BETWEEN 10 AND 20 AND y BETWEEN 0 AND 5 AND z BETWEEN 0 AND 50) AND cls NOT IN (5, 6)")
def box_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return points.outside_boxes(_observations(spark, d), [(10, 0, 0, 20, 5, 50)], [5, 6]).select(*KEY)


@query(f"SELECT CASE WHEN cls = 7 THEN 3 WHEN conf_pct < 30 THEN 5 WHEN frame % 3 < 1 THEN 2 ELSE 1 END AS state, count(*) AS n, round_even(100.0 * count(*) / (SELECT count(*) FROM {OBS}), 6) AS pct FROM {OBS} GROUP BY ALL")
def observation_states(spark: SparkSession, d: str) -> DataFrame:
    o = _observations(spark, d)
    state = rules.observation_state(F.col("cls") == 7, F.col("conf_pct") / 100, F.when(F.col("frame") % 3 < 1, 1).otherwise(2))
    counts = o.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(o.agg(F.count(F.lit(1)).alias("t")))).select("state", "n", F.bround(100.0 * F.col("n") / F.col("t"), 6).alias("pct"))


_CELLS = f"(SELECT CAST(floor(((SELECT max(y) FROM {OBS}) - y) / 2) AS BIGINT) AS row, CAST(floor((x - (SELECT min(x) FROM {OBS})) / 2) AS BIGINT) AS col, min(z) AS dem, max(z) AS dsm FROM {OBS} WHERE cls IN (2, 3) GROUP BY 1, 2)"


@query(f"SELECT * FROM {_CELLS}")
def elevation(spark: SparkSession, d: str) -> DataFrame:
    o = _observations(spark, d)
    ext = o.agg(F.min("x").alias("x0"), F.max("y").alias("y1"))
    ground = rasters.ground_points(o).crossJoin(F.broadcast(ext)).withColumn("y", F.col("y") - F.col("y1")).withColumn("x", F.col("x") - F.col("x0"))
    cells = ground.select(F.floor(-F.col("y") / 2).alias("row"), F.floor(F.col("x") / 2).alias("col"), "z")
    return cells.groupBy("row", "col").agg(F.min("z").alias("dem"), F.max("z").alias("dsm"))


_GRID = f"(SELECT CAST(l_orderkey % 97 AS BIGINT) AS row, CAST(l_partkey % 89 AS BIGINT) AS col, min(z) AS z FROM {OBS} GROUP BY 1, 2)"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """Cells of all observations."""
    return _observations(spark, d).groupBy((F.col("l_orderkey") % 97).alias("row"), (F.col("l_partkey") % 89).alias("col")).agg(F.min("z").alias("z"))


@query(f"""
WITH c AS (SELECT * FROM {_GRID}), s AS (SELECT row + i AS row, col + j AS col, z FROM c, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j) WHERE i <> 0 OR j <> 0)
SELECT row, col, round_even(z, 6) AS z, false AS filled FROM c UNION ALL
SELECT s.row, s.col, round_even(avg(s.z), 6), true FROM s ANTI JOIN c ON c.row = s.row AND c.col = s.col WHERE s.row BETWEEN (SELECT min(row) FROM c) AND (SELECT max(row) FROM c) AND s.col BETWEEN (SELECT min(col) FROM c) AND (SELECT max(col) FROM c) GROUP BY s.row, s.col""")
def void_fill(spark: SparkSession, d: str) -> DataFrame:
    return rasters.fill_voids(_grid(spark, d), "z").withColumn("z", F.bround("z", 6))


@query(f"SELECT min(z) AS low, max(z) AS high, round_even(avg(z), 6) AS mean, count(z) AS valid, (max(row) + 1) * (max(col) + 1) - count(z) AS nodata FROM {_GRID}")
def raster_metadata(spark: SparkSession, d: str) -> DataFrame:
    return rasters.metadata(_grid(spark, d), "z").withColumn("mean", F.bround("mean", 6))


_MASK = f"(SELECT DISTINCT CAST(frame % 4 AS INT) AS frame, CAST(l_orderkey % 61 AS BIGINT) AS v, CAST(l_partkey % 67 AS BIGINT) AS u FROM {OBS} WHERE cls = 7)"


@query(f"SELECT DISTINCT frame, v + i AS v, u + j AS u FROM {_MASK}, (VALUES (-2), (-1), (0), (1), (2)) a(i), (VALUES (-2), (-1), (0), (1), (2)) b(j) WHERE (abs(i) < 2 OR j = 0) AND v + i BETWEEN 0 AND 60 AND u + j BETWEEN 0 AND 66")
def mask_dilation(spark: SparkSession, d: str) -> DataFrame:
    m = _observations(spark, d).filter("cls = 7").select((F.col("frame") % 4).alias("frame"), (F.col("l_orderkey") % 61).alias("v"), (F.col("l_partkey") % 67).alias("u")).distinct()
    return rasters.dilate(m, 61, 67)


_PIX = f"(SELECT frame % 4 AS frame, l_orderkey % 61 AS v, l_partkey % 67 AS u, max(conf_pct) AS conf, max(cls) AS cls FROM {OBS} GROUP BY 1, 2, 3)"


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    return _observations(spark, d).groupBy((F.col("frame") % 4).alias("frame"), (F.col("l_orderkey") % 61).alias("v"), (F.col("l_partkey") % 67).alias("u")).agg(F.max("conf_pct").alias("conf"), F.max("cls").alias("cls"))


@query(f"SELECT frame, v // 2 AS v, u // 2 AS u, round_even(avg(conf), 6) AS conf, max(CASE WHEN v % 2 = 0 AND u % 2 = 0 THEN cls END) AS cls FROM {_PIX} GROUP BY frame, v // 2, u // 2")
def mask_pyramid(spark: SparkSession, d: str) -> DataFrame:
    return rasters.half(_pixels(spark, d), "conf", "cls").withColumn("conf", F.bround("conf", 6))


@query(f"WITH p AS (SELECT * FROM {_PIX}), t AS (SELECT frame, count(*) AS t FROM p GROUP BY frame), c AS (SELECT frame, cls, count(*) AS n FROM p GROUP BY ALL) SELECT t.frame, k.cls, round_even(coalesce(n, 0) / t.t, 6) AS share FROM t CROSS JOIN (SELECT CAST(range AS INT) AS cls FROM range(11)) k LEFT JOIN c ON c.frame = t.frame AND c.cls = k.cls")
def class_proportions(spark: SparkSession, d: str) -> DataFrame:
    dim = spark.range(11).select(F.col("id").cast("int").alias("cls"))
    return rasters.proportions(_pixels(spark, d), dim).withColumn("share", F.bround("share", 6))


FRAMES = sql("frames")


@query(f"SELECT job_id, frame_index, arg_max(frame_index, row(blur, -frame_index)) OVER w AS best_index, max(blur) OVER w AS best_blur FROM {FRAMES} WINDOW w AS (PARTITION BY job_id ORDER BY frame_index ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def sharpest_neighbour(spark: SparkSession, d: str) -> DataFrame:
    return fr.sharpest_near(view(spark, d, "frames"), 3).select("job_id", "frame_index", "best_index", "best_blur")


@query(f"SELECT a.job_id, a.frame_index AS a, b.frame_index AS b FROM {FRAMES} a JOIN {FRAMES} b ON a.job_id = b.job_id AND b.frame_index BETWEEN a.frame_index + 1 AND a.frame_index + 4")
def keyframe_pairs(spark: SparkSession, d: str) -> DataFrame:
    return fr.pairs(view(spark, d, "frames"), 3)


_MATCH = f"(SELECT a.job_id, a.frame_index * 10 + b.frame_index - a.frame_index AS pos, a.frame_index AS a, b.frame_index AS b, (a.frame_index * 7 + b.frame_index) % 100 AS inliers FROM {FRAMES} a JOIN {FRAMES} b ON a.job_id = b.job_id AND b.frame_index BETWEEN a.frame_index + 1 AND a.frame_index + 3)"


@query(f"""
WITH m AS (SELECT * FROM {_MATCH}), s AS (SELECT job_id, b AS frame, sum(inliers) AS credit, min(pos) AS p FROM m GROUP BY ALL), f AS (SELECT job_id, a AS frame, arg_min(inliers, pos) AS own, min(pos) AS p FROM m GROUP BY ALL)
SELECT job_id, frame, CAST(coalesce(s.credit, 0) + CASE WHEN f.own IS NOT NULL AND (s.p IS NULL OR f.p < s.p) THEN f.own ELSE 0 END AS BIGINT) AS credit FROM s FULL JOIN f USING (job_id, frame)""")
def inlier_credit(spark: SparkSession, d: str) -> DataFrame:
    m = fr.pairs(view(spark, d, "frames"), 2)
    m = m.select("job_id", (F.col("a") * 10 + F.col("b") - F.col("a")).alias("pos"), "a", "b", ((F.col("a") * 7 + F.col("b")) % 100).alias("inliers"))
    return fr.inlier_credit(m)


@query(f"SELECT job_id, frame_index, median(blur) OVER (PARTITION BY job_id ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM {FRAMES}")
def scale_smoothing(spark: SparkSession, d: str) -> DataFrame:
    return fr.running_median(view(spark, d, "frames"), "blur").select("job_id", "frame_index", "smooth")


@query(f"WITH c AS (SELECT job_id, CAST(floor(blur / 10) AS BIGINT) AS mode, count(*) AS n, min(frame_index) AS f FROM {FRAMES} GROUP BY ALL) SELECT job_id, arg_max(mode, row(n, -f)) AS mode, max(n) AS n FROM c GROUP BY job_id")
def dominant_mode(spark: SparkSession, d: str) -> DataFrame:
    return fr.dominant(view(spark, d, "frames").withColumn("mode", F.floor(F.col("blur") / 10)), "mode", "frame_index")


@query()
def keyframe_selection(spark: SparkSession, d: str) -> DataFrame:
    """Sequential: each choice is the reference of the next. Tested on fixtures."""
    return fr.select_keyframes(view(spark, d, "frames"))


FACES, VERTICES = sql("faces"), sql("vertices")
_SIDES = f"(SELECT fid, least(p, q) AS a, greatest(p, q) AS b FROM (SELECT fid, i0 AS p, i1 AS q FROM {FACES} UNION ALL SELECT fid, i1, i2 FROM {FACES} UNION ALL SELECT fid, i2, i0 FROM {FACES}) WHERE p <> q)"


@query(f"SELECT a, b, count(*) AS faces, CASE count(*) WHEN 1 THEN 'boundary' WHEN 2 THEN 'manifold' ELSE 'non-manifold' END AS kind FROM {_SIDES} GROUP BY a, b")
def mesh_edges(spark: SparkSession, d: str) -> DataFrame:
    return meshes.edge_kinds(view(spark, d, "faces"))


@query(f"SELECT fid FROM {FACES} WHERE fid NOT IN (SELECT fid FROM (SELECT fid, row_number() OVER (PARTITION BY a, b ORDER BY fid) AS n FROM {_SIDES}) WHERE n > 2)")
def manifold_faces(spark: SparkSession, d: str) -> DataFrame:
    return meshes.manifold_faces(view(spark, d, "faces")).select("fid")


_CORNERS = f"(SELECT f.fid, f.i0, f.i1, f.i2, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM {FACES} f JOIN {VERTICES} a ON a.vid = i0 JOIN {VERTICES} b ON b.vid = i1 JOIN {VERTICES} c ON c.vid = i2)"
_AREA = "sqrt(pow((by_ - ay) * (cz - az) - (bz - az) * (cy - ay), 2) + pow((bz - az) * (cx - ax) - (bx - ax) * (cz - az), 2) + pow((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax), 2)) / 2"
_LONG = "greatest(sqrt(pow(ax - bx, 2) + pow(ay - by_, 2) + pow(az - bz, 2)), sqrt(pow(bx - cx, 2) + pow(by_ - cy, 2) + pow(bz - cz, 2)), sqrt(pow(cx - ax, 2) + pow(cy - ay, 2) + pow(cz - az, 2)))"


@query(f"WITH m AS (SELECT fid, list_sort([i0, i1, i2]) AS k, {_AREA} AS area, {_LONG} AS longest FROM {_CORNERS} WHERE i0 <> i1 AND i1 <> i2 AND i2 <> i0) SELECT min(fid) AS fid, round_even(arg_min(area, fid), 6) AS area, round_even(arg_min(longest, fid), 6) AS longest FROM m WHERE area > 1e-7 GROUP BY k")
def sound_faces(spark: SparkSession, d: str) -> DataFrame:
    out = meshes.sound_faces(view(spark, d, "faces"), view(spark, d, "vertices"))
    return out.select("fid", F.bround("area", 6).alias("area"), F.bround("longest", 6).alias("longest"))


@query(f"WITH m AS (SELECT fid, {_LONG} AS longest FROM {_CORNERS}) SELECT fid FROM m WHERE longest <= 1.2 * (SELECT median(longest) FROM m)")
def trim_long_faces(spark: SparkSession, d: str) -> DataFrame:
    return meshes.trim_long(meshes.measured(view(spark, d, "faces"), view(spark, d, "vertices")), 1.2).select("fid")


@query(f"SELECT fid, CASE WHEN ax % 3 = bx % 3 THEN 0 ELSE 1 END AS x FROM {_CORNERS} WHERE false UNION ALL SELECT fid, CAST(CASE WHEN (ax + bx + cx) / 3 >= (SELECT (min(x) + max(x)) / 2 FROM {VERTICES}) THEN 1 ELSE 0 END + 2 * CASE WHEN (ay + by_ + cy) / 3 >= (SELECT (min(y) + max(y)) / 2 FROM {VERTICES}) THEN 1 ELSE 0 END AS INT) FROM {_CORNERS}")
def tile_quadrants(spark: SparkSession, d: str) -> DataFrame:
    return meshes.quadrants(view(spark, d, "faces"), view(spark, d, "vertices")).select("fid", F.col("tile").alias("x"))


_VIEWS = [(k, float(3 * k), float(20 - 2 * k), 30.0, 1.0 + k / 10) for k in range(6)]
_SEEN = f"""
v(view, x, y, z, s) AS (VALUES {", ".join(f"({k}, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE, {q}::DOUBLE)" for k, x, y, z, q in _VIEWS)}),
n AS (SELECT fid, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz,
  (ax + bx + cx) / 3 AS mx, (ay + by_ + cy) / 3 AS my, (az + bz + cz) / 3 AS mz FROM {_CORNERS}),
l AS (SELECT n.*, v.*, sqrt(nx * nx + ny * ny + nz * nz) AS size, sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) AS dist FROM n, v),
r AS (SELECT *, (nx * (x - mx) + ny * (y - my) + nz * (z - mz)) / (size * dist) AS cos FROM l WHERE size > 0),
best AS (SELECT fid, arg_max(view, row(sc, -view)) FILTER (sc IS NOT NULL) AS view, max(sc) AS score, degrees(acos(least(1.0, arg_max(cos, row(sc, -view)) FILTER (sc IS NOT NULL)))) AS angle
  FROM (SELECT *, CASE WHEN dist >= 1e-4 AND cos > 0 THEN cos / (1 + 0.05 * dist) * s END AS sc FROM r) GROUP BY fid)"""


def _best_views(spark: SparkSession, d: str) -> DataFrame:
    return meshes.select_views(view(spark, d, "faces"), view(spark, d, "vertices"), _VIEWS)


@query(f"WITH {_SEEN} SELECT fid, view, round_even(score, 6) AS score, round_even(angle, 6) AS angle FROM best")
def view_selection(spark: SparkSession, d: str) -> DataFrame:
    """The best view of each face."""
    return _best_views(spark, d).withColumns({c: F.bround(c, 6) for c in ("score", "angle")})


@query(f"""
WITH {_SEEN}, f AS (SELECT fid FROM best), u AS (SELECT view, count(*) AS n, avg(angle) AS mean_angle, avg(CASE WHEN angle <= 60 THEN 100.0 ELSE 0.0 END) AS good FROM best WHERE view IS NOT NULL GROUP BY view)
SELECT v.view, coalesce(u.n, 0) AS faces, round_even(100.0 * coalesce(u.n, 0) / (SELECT count(*) FROM f), 6) AS pct, round_even(mean_angle, 6) AS mean_angle, round_even(good, 6) AS good_pct FROM v LEFT JOIN u USING (view)""")
def view_utilisation(spark: SparkSession, d: str) -> DataFrame:
    """How many faces each view serves, views without a face included, the mean angle and the share up to 60 degrees."""
    frames = spark.createDataFrame([(v[0],) for v in _VIEWS], "view int")
    return meshes.view_utilisation(_best_views(spark, d), frames).withColumns({c: F.bround(c, 6) for c in ("pct", "mean_angle", "good_pct")})


@query(f"SELECT CAST(cls AS INT) AS cls, bool_or(conf_pct < 40) AS ever, count(DISTINCT frame) AS frames FROM {OBS} GROUP BY cls")
def track_states(spark: SparkSession, d: str) -> DataFrame:
    o = _observations(spark, d)
    return o.groupBy("cls").agg(F.bool_or(F.col("conf_pct") < 40).alias("ever"), F.count_distinct("frame").alias("frames"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, avg(conf_pct) OVER (PARTITION BY frame ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 60 AS moving FROM {OBS}")
def motion_smoothing(spark: SparkSession, d: str) -> DataFrame:
    return tracks.smoothed_motion(_observations(spark, d), "frame", KEY, "conf_pct", 60.0).select(*KEY, "moving")


_ALL_BOXES = f"(SELECT row(l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS id, l_orderkey, l_linenumber, l_partkey % 50 AS x0, l_suppkey % 50 AS y0, l_partkey % 50 + 5 + l_linenumber AS x1, l_suppkey % 50 + 9 AS y1, frame, l_partkey FROM {OBS})"


@query(f"WITH b AS (SELECT * FROM {_ALL_BOXES}), p AS (SELECT frame, a.l_orderkey AS a_orderkey, a.l_linenumber AS a_linenumber, a.l_partkey AS a_partkey, b.l_orderkey AS b_orderkey, b.l_linenumber AS b_linenumber, b.l_partkey AS b_partkey, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb FROM b a JOIN b USING (frame) WHERE a.id < b.id) SELECT * EXCLUDE (i, sa, sb), round_even(i / (sa + sb - i), 6) AS iou FROM p WHERE i / (sa + sb - i) >= 0.3")
def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps among the boxes of all lines; rows with equal keys are boxes of their own."""
    o = _observations(spark, d).withColumn("copy", F.row_number().over(Window.partitionBy(*KEY).orderBy("x", "y", "z", "conf_pct")))
    boxes = o.select(F.struct(*KEY, "copy").alias("id"), "frame", F.array(F.col("l_partkey") % 50, F.col("l_suppkey") % 50, F.col("l_partkey") % 50 + 5 + F.col("l_linenumber"), F.col("l_suppkey") % 50 + 9).alias("box"))
    sides = [F.col(f"{side}.l_{c}").alias(f"{side}_{c}") for side in "ab" for c in ("orderkey", "linenumber", "partkey")]
    return tracks.overlapping(boxes, "frame", "id", 0.3, digits=6).select("frame", *sides, "iou")


@query(f"SELECT count(*) AS pixels, count(DISTINCT frame) AS frames, round_even(avg(f), 6) AS mean_fraction, round_even(max(f), 6) AS max_fraction FROM (SELECT frame, avg(CASE WHEN cls >= 5 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY frame) AS f FROM {_PIX})")
def contamination(spark: SparkSession, d: str) -> DataFrame:
    f = F.avg((F.col("cls") >= 5).cast("double")).over(Window.partitionBy("frame"))
    return _pixels(spark, d).withColumn("f", f).agg(F.count(F.lit(1)).alias("pixels"), F.count_distinct("frame").alias("frames"), F.bround(F.avg("f"), 6).alias("mean_fraction"), F.bround(F.max("f"), 6).alias("max_fraction"))


@query(f"WITH z AS (SELECT x - (x + (l_orderkey % 3) / 10) AS dx, y - (y + (l_partkey % 5) / 10) AS dy, (l_suppkey % 7) / 10 AS dz FROM {OBS}) SELECT round_even(sqrt(avg(dx * dx + dy * dy)), 6) AS horizontal, round_even(sqrt(avg(dz * dz)), 6) AS vertical, round_even(sqrt(avg(dx * dx + dy * dy + dz * dz)), 6) AS spatial, sqrt(avg(dx * dx + dy * dy)) <= 0.5 AS on_target FROM z")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    o = _observations(spark, d).select(*[F.col(c).alias(f"e{c}") for c in ("x", "y", "z")], (F.col("x") + (F.col("l_orderkey") % 3) / 10).alias("rx"), (F.col("y") + (F.col("l_partkey") % 5) / 10).alias("ry"), (F.col("z") + (F.col("l_suppkey") % 7) / 10).alias("rz"))
    out = tracks.accuracy(o)
    return out.select(*[F.bround(c, 6).alias(c) for c in ("horizontal", "vertical", "spatial")], "on_target")


@query("SELECT 2.0 AS scale, 0.0 AS r00, -1.0 AS r01, 1.0 AS r10, 10.0 AS tx, -5.0 AS ty, 3.0 AS tz")
def similarity_fit(spark: SparkSession, d: str) -> DataFrame:
    """A known transform (scale 2, a quarter turn, a shift) found again from pairs."""
    o = _observations(spark, d)
    pairs = o.select(*[F.col(c).alias(f"s{c}") for c in ("x", "y", "z")], (10 - 2 * F.col("y")).alias("tx"), (2 * F.col("x") - 5).alias("ty"), (2 * F.col("z") + 3).alias("tz"))
    scale, r, t = alignment.umeyama(pairs)
    return spark.createDataFrame([tuple(round(float(v), 6) + 0.0 for v in (scale, r[0, 0], r[0, 1], r[1, 0], *t))], "scale double, r00 double, r01 double, r10 double, tx double, ty double, tz double")


@query("""
WITH d AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS n, lead(d) OVER (PARTITION BY a ORDER BY d, b) AS second FROM d)
SELECT a, b, round_even(d, 5) AS d FROM n WHERE n = 1 AND d < 0.95 * second""")
def descriptor_matches(spark: SparkSession, d: str) -> DataFrame:
    """Nearest descriptors of the same label that are clearly nearer than the second."""
    v = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return alignment.ratio_matches(v, v, "label", 0.95).withColumn("d", F.bround("d", 5))
