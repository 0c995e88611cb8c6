"""Triangle meshes as tables: faces (fid, i0, i1, i2), vertices (vid, x, y, z), views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CORNERS = ("i0", "i1", "i2")


def edges(faces: DataFrame) -> DataFrame:
    """fid, a < b for each side of a face with three different corners."""
    sides = F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("i0", "i1"), ("i1", "i2"), ("i2", "i0"))])
    return faces.select("fid", F.explode(sides).alias("e")).select("fid", "e.a", "e.b").filter("a <> b")


def edge_kinds(faces: DataFrame) -> DataFrame:
    """a, b, faces, kind: boundary (1 face), manifold (2) or non-manifold."""
    counts = edges(faces).groupBy("a", "b").agg(F.count(F.lit(1)).alias("faces"))
    return counts.withColumn("kind", F.when(F.col("faces") == 1, "boundary").when(F.col("faces") == 2, "manifold").otherwise("non-manifold"))


def manifold_faces(faces: DataFrame) -> DataFrame:
    """Faces of which no side is the third or later of its edge, in order of fid."""
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("fid"))
    extra = edges(faces).withColumn("n", rank).filter("n > 2").select("fid").distinct()
    return faces.join(extra, "fid", "left_anti")


def with_corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """faces with a struct of x, y, z for each corner; faces with a missing vertex go."""
    out = faces
    for k, c in enumerate(_CORNERS):
        out = out.join(vertices.select(F.col("vid").alias(c), F.struct("x", "y", "z").alias(f"p{k}")), c)
    return out


def _minus(p: Column, q: Column) -> list[Column]:
    return [p[c] - q[c] for c in ("x", "y", "z")]


def _length(v: list[Column]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def normal(p0: Column, p1: Column, p2: Column) -> list[Column]:
    """The cross product of two sides: twice the area along the unit normal."""
    a, b = _minus(p1, p0), _minus(p2, p0)
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def measured(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """fid, corners, area and longest side."""
    p = [F.col(f"p{k}") for k in range(3)]
    sides = [_length(_minus(p[i], p[j])) for i, j in ((0, 1), (1, 2), (2, 0))]
    return with_corners(faces, vertices).select("fid", *_CORNERS, (_length(normal(*p)) / 2).alias("area"), F.greatest(*sides).alias("longest"))


def sound_faces(faces: DataFrame, vertices: DataFrame, least_area: float = 1e-7) -> DataFrame:
    """Faces with three corners and an area, each set of corners once (lowest fid)."""
    different = "i0 <> i1 and i1 <> i2 and i2 <> i0"
    rows = measured(faces.filter(different), vertices).filter(F.col("area") > least_area)
    corners = F.array_sort(F.array(*_CORNERS))
    return rows.groupBy(corners.alias("corners")).agg(F.min(F.struct("fid", *_CORNERS, "area", "longest")).alias("f")).select("f.*")


def trim_long(rows: DataFrame, factor: float = 3.5) -> DataFrame:
    """Rows of ``measured`` whose longest side is at most factor times the median (one row, broadcast)."""
    limit = rows.agg((F.percentile("longest", F.lit(0.5)) * factor).alias("limit"))
    return rows.crossJoin(F.broadcast(limit)).filter(F.col("longest") <= F.col("limit")).drop("limit")


def select_views(faces: DataFrame, vertices: DataFrame, views: list[tuple[int, float, float, float, float]]) -> DataFrame:
    """fid, view, score, angle: the view (frame, x, y, z, sharpness) that sees a face best, null if none does; the earlier one wins a tie.

    The views of a job, some hundreds, are a literal array: each face is rated once for each, and the best of them is taken
    before the shuffle by fid.
    """
    p = [F.col(f"p{k}") for k in range(3)]
    table = F.array(*[F.struct(F.lit(-i).alias("at"), F.lit(v[0]).alias("frame"), *[F.lit(float(x)).alias(c) for x, c in zip(v[1:], "xyzs", strict=True)]) for i, v in enumerate(views)])
    rows = with_corners(faces, vertices)
    rows = rows.select("fid", *[c.alias(f"n{a}") for a, c in zip("xyz", normal(*p), strict=True)], *[((p[0][a] + p[1][a] + p[2][a]) / 3).alias(f"m{a}") for a in "xyz"])
    rows = rows.withColumn("size", _length([F.col("nx"), F.col("ny"), F.col("nz")])).filter("size > 0").withColumn("v", F.explode(table))
    rows = rows.select("fid", "nx", "ny", "nz", "size", "v", *[(F.col("v")[a] - F.col(f"m{a}")).alias(f"d{a}") for a in "xyz"])
    rows = rows.withColumn("dist", _length([F.col("dx"), F.col("dy"), F.col("dz")])).withColumn("cos", F.expr("(nx * dx + ny * dy + nz * dz) / (size * dist)"))
    rated = F.struct((F.col("cos") / (1 + 0.05 * F.col("dist")) * F.col("v.s")).alias("score"), "v.at", "v.frame", "cos")
    best = rows.groupBy("fid").agg(F.max(F.when((F.col("dist") >= 1e-4) & (F.col("cos") > 0), rated)).alias("best"))
    return best.select("fid", F.col("best.frame").alias("view"), F.col("best.score").alias("score"), F.degrees(F.acos(F.least(F.lit(1.0), F.col("best.cos")))).alias("angle"))


def view_utilisation(chosen: DataFrame, views: DataFrame, good: float = 60.0) -> DataFrame:
    """view, faces, pct of all faces, mean_angle, good_pct (up to ``good`` degrees) for every view, from the rows of ``select_views``."""
    used = chosen.filter("view is not null").groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.avg("angle").alias("mean_angle"), F.avg(F.when(F.col("angle") <= good, 100.0).otherwise(0.0)).alias("good_pct"))
    total = chosen.agg(F.count(F.lit(1)).alias("total"))
    n = F.coalesce("n", F.lit(0))
    return views.join(used, "view", "left").crossJoin(F.broadcast(total)).select("view", n.alias("faces"), (100.0 * n / F.col("total")).alias("pct"), "mean_angle", "good_pct")


def quadrants(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """fid, tile 0-3 by the centroid about the middle of the extent; half-open, so that each face has one tile."""
    rows = with_corners(faces, vertices)
    mid = vertices.agg(((F.min("x") + F.max("x")) / 2).alias("mx"), ((F.min("y") + F.max("y")) / 2).alias("my"))
    cx, cy = [(F.col("p0")[c] + F.col("p1")[c] + F.col("p2")[c]) / 3 for c in ("x", "y")]
    return rows.crossJoin(F.broadcast(mid)).select("fid", ((cx >= F.col("mx")).cast("int") + 2 * (cy >= F.col("my")).cast("int")).alias("tile"))


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """vid, nx, ny, nz: the mean of the normals of a vertex's faces, by area; up where there is none."""
    rows = with_corners(faces, vertices)
    n = [c.alias(f"n{a}") for a, c in zip("xyz", normal(*[F.col(f"p{k}") for k in range(3)]), strict=True)]
    sums = rows.select(F.explode(F.array(*_CORNERS)).alias("vid"), *n).groupBy("vid").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in "xyz"])
    size = _length([F.col("nx"), F.col("ny"), F.col("nz")])
    some = F.coalesce(size > 0, F.lit(False))
    return vertices.select("vid").join(sums, "vid", "left").withColumn("size", size).select("vid", *[F.when(some, F.col(f"n{a}") / F.col("size")).otherwise(1.0 if a == "z" else 0.0).alias(f"n{a}") for a in "xyz"])


def vertex_uv(vertices: DataFrame) -> DataFrame:
    """vid, u, v: the place of each vertex in the bounding rectangle of all (one row, broadcast)."""
    box = vertices.agg(*[F.min(c).alias(f"{c}0") for c in "xy"], *[F.greatest(F.lit(1e-4), F.max(c) - F.min(c)).alias(f"d{c}") for c in "xy"])
    return vertices.crossJoin(F.broadcast(box)).select("vid", ((F.col("x") - F.col("x0")) / F.col("dx")).alias("u"), ((F.col("y") - F.col("y0")) / F.col("dy")).alias("v"))


def planar_uv(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """fid, corner, u, v of each corner, by ``vertex_uv``."""
    uv = vertex_uv(vertices)
    corners = F.posexplode(F.array(*_CORNERS)).alias("corner", "vid")
    return faces.select("fid", corners).join(uv, "vid").select("fid", "corner", "u", "v")


def reindexed(faces: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """The vertices used by the faces of each part (by, vid, index from 0 in order of vid), and the faces with these indices."""
    used = faces.select(by, F.explode(F.array(*_CORNERS)).alias("vid")).distinct()
    used = used.withColumn("index", F.row_number().over(Window.partitionBy(by).orderBy("vid")) - 1)
    out = faces
    for c in _CORNERS:
        out = out.join(used.select(by, F.col("vid").alias(c), F.col("index").alias(f"n{c}")), [by, c])
    return used, out.select(by, "fid", *[F.col(f"n{c}").alias(c) for c in _CORNERS])


def edge_lengths(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """a, b, length of every edge once."""
    rows = edges(faces).select("a", "b").distinct()
    for c in "ab":
        rows = rows.join(vertices.select(F.col("vid").alias(c), F.struct("x", "y", "z").alias(f"p{c}")), c)
    return rows.select("a", "b", _length(_minus(F.col("pa"), F.col("pb"))).alias("length"))
