"""Queries over a terrain surface: a grid mesh with holes whose size follows the orders, and images on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.operators import surfaces, textures
from aerolith.plans.views import table

QUERIES: dict = {}
ORACLE: dict = {}
#: Vertices across the strip of terrain.
ACROSS = 64

_VERTICES = """(SELECT o_orderkey AS vid, (o_orderkey % 64) * 0.5 AS x, (o_orderkey // 64) * 0.5 AS y, (CAST(floor(o_totalprice) AS BIGINT) % 20) / 100.0 AS z FROM orders WHERE o_custkey % 13 <> 0)"""
_FACES = """(SELECT 2 * a.vid AS fid, a.vid AS i0, b.vid AS i1, d.vid AS i2 FROM v a JOIN v b ON b.vid = a.vid + 1 JOIN v c ON c.vid = a.vid + 64 JOIN v d ON d.vid = a.vid + 65 WHERE a.vid % 64 < 63
  UNION ALL SELECT 2 * a.vid + 1, a.vid, d.vid, c.vid FROM v a JOIN v b ON b.vid = a.vid + 1 JOIN v c ON c.vid = a.vid + 64 JOIN v d ON d.vid = a.vid + 65 WHERE a.vid % 64 < 63)"""
_LOOPS = f"""
WITH RECURSIVE v AS {_VERTICES}, f AS {_FACES},
s AS (SELECT i0 AS u, i1 AS v, i2 AS w FROM f UNION ALL SELECT i1, i2, i0 FROM f UNION ALL SELECT i2, i0, i1 FROM f),
border AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.u = s.v AND t.v = s.u)),
turns AS (SELECT u, v, w AS at FROM border UNION ALL SELECT r.u, r.v, s.w FROM turns r JOIN s ON s.u = r.at AND s.v = r.v),
follow AS (SELECT r.u, r.v, r.at AS nv FROM turns r JOIN border b ON b.u = r.v AND b.v = r.at),
walk AS (
  SELECT u AS loop_u, v AS loop_v, CAST(0 AS BIGINT) AS place, u, v FROM border
  UNION ALL SELECT w.loop_u, w.loop_v, w.place + 1, w.v, n.nv FROM walk w JOIN follow n ON n.u = w.u AND n.v = w.v WHERE w.v > w.loop_u OR (w.v = w.loop_u AND n.nv > w.loop_v)
),
closed AS (SELECT w.loop_u, w.loop_v, w.place + 1 AS length FROM walk w JOIN follow n ON n.u = w.u AND n.v = w.v WHERE w.v = w.loop_u AND n.nv = w.loop_v),
loops AS (SELECT w.loop_u, w.loop_v, w.place, c.length, w.u, w.v FROM walk w JOIN closed c ON c.loop_u = w.loop_u AND c.loop_v = w.loop_v)
"""


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def terrain(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Faces and vertices: a strip of squares of half a metre, cut along a diagonal, where all four corners were measured."""
    i = F.col("o_orderkey")
    rows = table(spark, d, "orders").filter("o_custkey % 13 <> 0")
    vertices = rows.select(i.alias("vid"), ((i % ACROSS) * 0.5).alias("x"), (F.floor(i / ACROSS) * 0.5).alias("y"), (F.floor("o_totalprice") % 20 / 100.0).alias("z"))
    # each vertex goes to the squares of which it is a corner; a square is named by its first one
    corners = F.array(*[F.struct((F.col("vid") - k).alias("square"), F.lit(n).alias("n")) for n, k in enumerate((0, 1, ACROSS, ACROSS + 1))])
    squares = vertices.select(F.explode(corners).alias("c")).groupBy("c.square").agg(F.count(F.lit(1)).alias("k")).filter((F.col("k") == 4) & (F.pmod("square", F.lit(ACROSS)) < ACROSS - 1))
    s = F.col("square")
    halves = F.array(*[F.struct((2 * s + n).alias("fid"), s.alias("i0"), p.alias("i1"), q.alias("i2")) for n, (p, q) in enumerate(((s + 1, s + ACROSS + 1), (s + ACROSS + 1, s + ACROSS)))])
    return squares.select(F.explode(halves).alias("f")).select("f.*"), vertices


@query(_LOOPS + "SELECT * FROM loops")
def boundary_loops(spark: SparkSession, d: str) -> DataFrame:
    """The boundary of the terrain as closed loops: the least side of each, and the place of every side in it."""
    return surfaces.boundary_loops(terrain(spark, d)[0])


_FANS = (
    _LOOPS
    + """, short AS (SELECT l.loop_u, l.loop_v, l.length, l.place, l.u, x, y, z FROM loops l JOIN v ON v.vid = l.u WHERE l.length BETWEEN 3 AND 24),
wide AS (SELECT a.loop_u, a.loop_v FROM short a JOIN short b USING (loop_u, loop_v) GROUP BY ALL HAVING max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) <= 2.0),
fans AS (
  SELECT a.loop_u, a.loop_v, b.place AS k, a.u AS i0, c.u AS i1, b.u AS i2 FROM wide JOIN short a USING (loop_u, loop_v) JOIN short b USING (loop_u, loop_v) JOIN short c ON c.loop_u = a.loop_u AND c.loop_v = a.loop_v AND c.place = b.place + 1
  WHERE a.place = 0 AND b.place >= 1
)
"""
)


@query(_FANS + "SELECT * FROM fans")
def hole_fill(spark: SparkSession, d: str) -> DataFrame:
    """The faces that close the small holes of the terrain."""
    return surfaces.fill_holes(*terrain(spark, d))


@query()
def levels_of_detail(spark: SparkSession, d: str) -> DataFrame:
    """The terrain at 100, 35 and 10 percent of its faces."""
    return surfaces.level_report(surfaces.levels_of_detail(*terrain(spark, d)))


_ATLAS = 300


@query(
    _FANS
    + """, e AS (SELECT fid, i0, i1, i2, false AS inferred FROM f UNION ALL SELECT 1000000000000 + (loop_u * 4096 + loop_v % 4096) * 32 + k, i0, i1, i2, true FROM fans),
box AS (SELECT min(x) AS x0, min(y) AS y0, greatest(1e-4, max(x) - min(x)) AS dx, greatest(1e-4, max(y) - min(y)) AS dy FROM v),
spot AS (SELECT vid, CAST(floor((x - x0) / dx * 299.0::DOUBLE) AS BIGINT) AS pu, CAST(floor((y - y0) / dy * 299.0::DOUBLE) AS BIGINT) AS pv FROM v, box),
t AS (SELECT fid, inferred, CAST(floor((i0 % 256 + i1 % 256 + i2 % 256) / 3) AS INT) AS r, CAST(floor((i0 % 200 + i1 % 200 + i2 % 200) / 3) AS INT) AS g, a.pu AS u0, a.pv AS v0, b.pu AS u1, b.pv AS v1, c.pu AS u2, c.pv AS v2
  FROM e JOIN spot a ON a.vid = i0 JOIN spot b ON b.vid = i1 JOIN spot c ON c.vid = i2),
n AS (SELECT *, unnest(range(least(v0, v1, v2), greatest(v0, v1, v2) + 1)) AS v FROM t),
m AS (SELECT *, unnest(range(least(u0, u1, u2), greatest(u0, u1, u2) + 1)) AS u FROM n),
edge AS (SELECT *, (u1 - u0) * (v - v0) - (v1 - v0) * (u - u0) AS s0, (u2 - u1) * (v - v1) - (v2 - v1) * (u - u1) AS s1, (u0 - u2) * (v - v2) - (v0 - v2) * (u - u2) AS s2 FROM m),
top AS (SELECT v, u, arg_max(r, fid) AS r, arg_max(g, fid) AS g, arg_max(inferred, fid) AS inferred FROM edge WHERE least(s0, s1, s2) >= 0 OR greatest(s0, s1, s2) <= 0 GROUP BY v, u),
grid AS (SELECT i // 300 AS v, i % 300 AS u FROM (SELECT unnest(range(90000)) AS i))
SELECT grid.v, grid.u, coalesce(r, 160) AS r, coalesce(g, 160) AS g, CASE WHEN inferred IS NULL THEN 160 ELSE 7 END AS b, CASE WHEN inferred IS NULL THEN 220 WHEN inferred THEN 80 ELSE 240 END AS confidence
FROM grid LEFT JOIN top ON top.v = grid.v AND top.u = grid.u"""
)
def texture_atlas(spark: SparkSession, d: str) -> DataFrame:
    """The terrain and the faces that close its small holes, drawn into an atlas."""
    faces, vertices = terrain(spark, d)
    number = 1_000_000_000_000 + (F.col("loop_u") * 4096 + F.col("loop_v") % 4096) * 32 + F.col("k")
    fans = surfaces.fill_holes(faces, vertices).select(number.alias("fid"), "i0", "i1", "i2", F.lit(True).alias("inferred"))
    colours = [(F.col("vid") % 256).alias("r"), (F.col("vid") % 200).alias("g"), F.lit(7).alias("b")]
    return textures.bake(faces.withColumn("inferred", F.lit(False)).unionByName(fans), vertices.select("*", *colours), _ATLAS)
