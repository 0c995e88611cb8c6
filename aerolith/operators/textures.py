"""Texture atlases: the faces of a mesh drawn into an image by scan conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.rules import texture_confidence
from aerolith.operators.meshes import vertex_uv

#: The colour and the confidence of an atlas where no face is.
BARE = (160, 160, 160)
BARE_CONFIDENCE = 220
#: Pixels on a side of the squares into which large faces are cut.
SQUARE = 64


def _side(p: tuple[Column, Column], q: tuple[Column, Column], u: Column, v: Column) -> Column:
    return (q[0] - p[0]) * (v - p[1]) - (q[1] - p[1]) * (u - p[0])


def corner_pixels(faces: DataFrame, vertices: DataFrame, size: int) -> DataFrame:
    """faces with u0, v0 .. u2, v2: where its corners lie in an atlas of size x size, by the bounding rectangle of all vertices, cut to whole pixels."""
    at = vertex_uv(vertices).select("vid", *[F.floor(F.col(c) * float(size - 1)).cast("long").alias(c) for c in "uv"])
    for k in range(3):
        faces = faces.join(at.select(F.col("vid").alias(f"i{k}"), F.col("u").alias(f"u{k}"), F.col("v").alias(f"v{k}")), f"i{k}")
    return faces


def covered(faces: DataFrame, payload: list[str]) -> DataFrame:
    """v, u and the payload of the last face (the largest fid) over each pixel, from the rows of ``corner_pixels``.

    A face covers the pixels in its closed triangle, in whole numbers, so that neighbours leave no gap. Faces wider or
    taller than a square are cut into squares that are dealt to all tasks before their pixels are listed; of a pixel each task
    sends the last face that it has.
    """
    us, vs = [F.col(f"u{k}") for k in range(3)], [F.col(f"v{k}") for k in range(3)]
    boxed = faces.withColumns({"ul": F.least(*us), "uh": F.greatest(*us), "vl": F.least(*vs), "vh": F.greatest(*vs)})
    small = (F.col("uh") - F.col("ul") < SQUARE) & (F.col("vh") - F.col("vl") < SQUARE)
    cut = boxed.filter(~small).withColumn("tv", F.explode(F.sequence(F.floor(F.col("vl") / SQUARE), F.floor(F.col("vh") / SQUARE)))).withColumn("tu", F.explode(F.sequence(F.floor(F.col("ul") / SQUARE), F.floor(F.col("uh") / SQUARE))))
    bounds = {f"{c}{e}": (F.greatest if e == "l" else F.least)(F.col(f"{c}{e}"), F.col(f"t{c}") * SQUARE + (0 if e == "l" else SQUARE - 1)) for c in "uv" for e in "lh"}
    cut = cut.withColumns(bounds).repartition("fid", "tv", "tu").drop("tv", "tu")
    rows = boxed.filter(small).unionByName(cut)
    rows = rows.withColumn("v", F.explode(F.sequence("vl", "vh"))).withColumn("u", F.explode(F.sequence("ul", "uh")))
    corners = list(zip(us, vs, strict=True))
    sides = [_side(corners[k], corners[(k + 1) % 3], F.col("u"), F.col("v")) for k in range(3)]
    rows = rows.filter((F.least(*sides) >= 0) | (F.greatest(*sides) <= 0))
    return rows.groupBy("v", "u").agg(F.max(F.struct("fid", *payload)).alias("top")).select("v", "u", "top.*")


def bake(faces: DataFrame, vertices: DataFrame, size: int) -> DataFrame:
    """v, u, r, g, b, confidence of every pixel of an atlas of size x size.

    faces are (fid, i0, i1, i2, inferred), vertices (vid, x, y, z, r, g, b); a face has the mean colour of its corners, cut to whole
    numbers, and less confidence where it was inferred. A face without one of its vertices isn't drawn.
    """
    coloured = faces
    for k in range(3):
        coloured = coloured.join(vertices.select(F.col("vid").alias(f"i{k}"), F.struct("r", "g", "b").alias(f"c{k}")), f"i{k}")
    mean = {c: F.floor(sum((F.col(f"c{k}")[c] for k in (1, 2)), F.col("c0")[c]) / 3).cast("int") for c in "rgb"}
    coloured = coloured.select("fid", "i0", "i1", "i2", *[v.alias(c) for c, v in mean.items()], texture_confidence(F.col("inferred")).alias("confidence"))
    drawn = covered(corner_pixels(coloured, vertices, size), ["r", "g", "b", "confidence"])
    grid = faces.sparkSession.range(size * size).select(F.floor(F.col("id") / size).alias("v"), (F.col("id") % size).alias("u"))
    bare = dict(zip("rgb", BARE, strict=True)) | {"confidence": BARE_CONFIDENCE}
    return grid.join(drawn, ["v", "u"], "left").select("v", "u", *[F.coalesce(c, F.lit(x)).alias(c) for c, x in bare.items()])
