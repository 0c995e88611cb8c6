"""Queries over class masks and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.operators import masks, rasters
from aerolith.plans.depths import rounded
from aerolith.plans.views import table

QUERIES: dict = {}
ORACLE: dict = {}
HEIGHT, WIDTH = 61, 67
PIXELS = """(SELECT CAST(l_suppkey % 4 AS BIGINT) AS frame, l_orderkey % 61 AS v, l_partkey % 67 AS u, CAST(max(l_linenumber) AS INT) AS cls, max(100 - round(l_tax * 1000)) / 100 AS conf
  FROM lineitem GROUP BY ALL)"""
BOXES = """(SELECT o_orderkey % 4 AS frame, o_orderkey AS position, CAST(o_custkey % 60 - 3 AS INT) AS x0, CAST(o_orderkey % 55 - 2 AS INT) AS y0,
  CAST(o_custkey % 60 + 4 + o_orderkey % 6 AS INT) AS x1, CAST(o_orderkey % 55 + 5 AS INT) AS y1, CAST(1 + o_custkey % 7 AS INT) AS cls,
  ['animal', 'moving_region', 'vehicle', 'person', 'tree'][1 + o_custkey % 5] AS category, CASE WHEN o_orderkey % 3 <> 0 THEN 'horse' END AS species, (o_orderkey % 100) / 100 AS sure FROM orders)"""


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    keys = [(F.col("l_suppkey") % 4).alias("frame"), (F.col("l_orderkey") % HEIGHT).alias("v"), (F.col("l_partkey") % WIDTH).alias("u")]
    return table(spark, d, "lineitem").groupBy(*keys).agg(F.max("l_linenumber").cast("int").alias("cls"), (F.max(100 - F.round(F.col("l_tax") * 1000)) / 100).alias("conf"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    kinds = F.array(*[F.lit(k) for k in ("animal", "moving_region", "vehicle", "person", "tree")])
    corners = [(c % 60 - 3).alias("x0"), (o % 55 - 2).alias("y0"), (c % 60 + 4 + o % 6).alias("x1"), (o % 55 + 5).alias("y1")]
    rows = table(spark, d, "orders").select((o % 4).alias("frame"), o.alias("position"), *corners, (1 + c % 7).cast("int").alias("cls"), F.get(kinds, (c % 5).cast("int")).alias("category"), F.when(o % 3 != 0, "horse").alias("species"), ((o % 100) / 100).alias("sure"))
    return rows.withColumns({k: F.col(k).cast("int") for k in ("x0", "y0", "x1", "y1")})


_DYNAMIC = f"(SELECT DISTINCT frame, v, u FROM {PIXELS} WHERE cls IN (5, 6))"


@query(f"SELECT p.frame, p.v, p.u, p.cls, CASE WHEN d.frame IS NULL THEN 0 ELSE 255 END AS dynamic, CAST(trunc(greatest(0, least(1, conf)) * 255) AS INT) AS conf, CASE WHEN d.frame IS NULL THEN p.cls ELSE 0 END AS still FROM {PIXELS} p LEFT JOIN {_DYNAMIC} d USING (frame, v, u)")
def mask_combination(spark: SparkSession, d: str) -> DataFrame:
    """Class, dynamic and confidence channels, and the class for static geometry."""
    p = _pixels(spark, d)
    return masks.combined(p, p.filter("cls in (5, 6)")).withColumn("still", masks.static_class(F.col("cls"), F.col("dynamic")))


_COLOURS = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(masks.PALETTE))


@query(f"SELECT frame, v, u, r, g, b FROM {PIXELS} JOIN (VALUES {_COLOURS}) k(cls, r, g, b) USING (cls)")
def mask_colours(spark: SparkSession, d: str) -> DataFrame:
    return masks.coloured(_pixels(spark, d)).select("frame", "v", "u", "r", "g", "b")


@query(f"SELECT frame, v * 2 + i AS v, u * 2 + j AS u, cls FROM {PIXELS}, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)")
def mask_upsampling(spark: SparkSession, d: str) -> DataFrame:
    return masks.nearest_upsampled(_pixels(spark, d).select("frame", "v", "u", "cls"), 2)


_CLAMPED = f"""
k AS (SELECT frame, position, cls, category, species, sure, greatest(0, least({WIDTH - 1}, x0)) AS x0, greatest(0, least({HEIGHT - 1}, y0)) AS y0, x1, y1 FROM {BOXES}),
b AS (SELECT * REPLACE (greatest(x0 + 1, least({WIDTH}, x1)) AS x1, greatest(y0 + 1, least({HEIGHT}, y1)) AS y1) FROM k)"""


@query(f"""
WITH {_CLAMPED}, m AS (SELECT b.*, p.v, p.u, p.cls = b.cls AS own FROM b JOIN {PIXELS} p ON p.frame = b.frame AND p.v >= y0 AND p.v < y1 AND p.u >= x0 AND p.u < x1),
s AS (SELECT frame, position, bool_or(own) AS hit FROM m GROUP BY ALL),
bare AS (SELECT b.* FROM b LEFT JOIN s USING (frame, position) WHERE NOT coalesce(hit, false))
SELECT DISTINCT frame, v, u FROM m WHERE own
UNION SELECT DISTINCT frame, y AS v, unnest(range(x0, x1)) AS u FROM (SELECT *, unnest(range(y0, y1)) AS y FROM bare)""")
def object_pixels(spark: SparkSession, d: str) -> DataFrame:
    """The pixels of moving objects: those of their class in their box, or the whole box."""
    return masks.object_pixels(_boxes(spark, d), _pixels(spark, d), HEIGHT, WIDTH)


@query(f"""
WITH {_CLAMPED}, c AS (SELECT *, CASE WHEN category = 'animal' THEN CASE WHEN species IS NOT NULL AND sure >= 0.7 THEN 9 ELSE 10 END WHEN category = 'moving_region' THEN 10 WHEN category = 'vehicle' THEN 5 WHEN category = 'person' THEN 6 END AS own FROM b),
t AS (SELECT p.frame, p.v, p.u, arg_max(own, position) AS own FROM {PIXELS} p JOIN c ON p.frame = c.frame AND p.v >= y0 AND p.v < y1 AND p.u >= x0 AND p.u < x1 WHERE own IS NOT NULL GROUP BY ALL)
SELECT p.frame, p.v, p.u, coalesce(t.own, p.cls) AS cls FROM {PIXELS} p LEFT JOIN t USING (frame, v, u)""")
def detection_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Classes with the detections over them, the last one on top."""
    found = _boxes(spark, d).withColumn("cls", masks.detection_class(F.col("category"), F.col("species"), F.col("sure")))
    return masks.overlaid(_pixels(spark, d), found, HEIGHT, WIDTH).select("frame", "v", "u", "cls")


@query("""
WITH f AS (SELECT l_suppkey AS frame, l_orderkey % 100 / 10 AS dx, l_partkey % 100 / 10 AS dy, l_linenumber <= 2 AS static FROM lineitem)
SELECT frame, round_even(CASE WHEN count(*) FILTER (static) < 100 THEN median(dx) ELSE median(dx) FILTER (static) END, 6) AS dx,
  round_even(CASE WHEN count(*) FILTER (static) < 100 THEN median(dy) ELSE median(dy) FILTER (static) END, 6) AS dy FROM f GROUP BY frame""")
def ego_motion(spark: SparkSession, d: str) -> DataFrame:
    flow = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("frame"), (F.col("l_orderkey") % 100 / 10).alias("dx"), (F.col("l_partkey") % 100 / 10).alias("dy"), (F.col("l_linenumber") <= 2).alias("static"))
    return rounded(masks.ego_motion(flow), "dx", "dy")


@query(f"""
WITH m AS (SELECT frame, count(*) FILTER (cls IN (5, 6)) AS pixels FROM {PIXELS} GROUP BY frame), o AS (SELECT frame, count(*) AS objects FROM {BOXES} GROUP BY frame)
SELECT CAST(sum(objects) AS BIGINT) AS objects, CAST(sum(pixels) AS BIGINT) AS pixels, round_even(avg(pixels / {HEIGHT * WIDTH}), 6) AS mean_fraction, round_even(max(pixels / {HEIGHT * WIDTH}), 6) AS max_fraction, count(*) FILTER (pixels > 0) AS frames
FROM m JOIN o USING (frame)""")
def contamination_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _pixels(spark, d).groupBy("frame").agg(F.count_if(F.col("cls").isin(5, 6)).alias("pixels"))
    rows = rows.join(_boxes(spark, d).groupBy("frame").agg(F.count(F.lit(1)).alias("objects")), "frame")
    return rounded(masks.contamination(rows, HEIGHT * WIDTH), "mean_fraction", "max_fraction")


@query(f"""
WITH p AS (SELECT * FROM {PIXELS}), t AS (SELECT frame, count(*) AS t FROM p GROUP BY frame), c AS (SELECT frame, cls, count(*) AS n FROM p GROUP BY ALL)
SELECT k.cls, round_even(avg(coalesce(n, 0) / t.t), 6) AS share FROM t CROSS JOIN (SELECT CAST(range AS INT) AS cls FROM range(11)) k LEFT JOIN c ON c.frame = t.frame AND c.cls = k.cls GROUP BY k.cls""")
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    """The mean over frames of the share of each class."""
    classes = spark.range(11).select(F.col("id").cast("int").alias("cls"))
    return rounded(masks.mean_distribution(rasters.proportions(_pixels(spark, d), classes)), "share")


@query()
def mask_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected regions of each class; compared with a flood fill in the tests."""
    return masks.components(_pixels(spark, d), 3)
