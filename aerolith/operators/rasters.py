"""Elevation rasters and masks as sparse cells (row, col, value); a missing row is NoData."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUND = (2, 3)
_NEAR = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


def ground_points(points: DataFrame, classes: tuple[int, ...] = GROUND, least: int = 10) -> DataFrame:
    """Ground points if there are more than ``least``, else all. The count is one row."""
    n = points.agg(F.count_if(F.col("cls").isin(*classes)).alias("__n"))
    return points.crossJoin(F.broadcast(n)).filter(F.col("cls").isin(*classes) | (F.col("__n") <= least)).drop("__n")


def elevation(points: DataFrame, size: float) -> DataFrame:
    """row, col, dem (lowest), dsm (highest); rows run down from the largest y."""
    extent = points.agg(F.min("x").alias("x0"), F.max("y").alias("y1"))
    cells = points.crossJoin(F.broadcast(extent)).select(F.floor((F.col("y1") - F.col("y")) / size).cast("long").alias("row"), F.floor((F.col("x") - F.col("x0")) / size).cast("long").alias("col"), "z")
    return cells.groupBy("row", "col").agg(F.min("z").alias("dem"), F.max("z").alias("dsm"))


def fill_voids(cells: DataFrame, value: str) -> DataFrame:
    """cells and, for each empty cell beside them within their extent, the mean of the eight cells around it (one pass)."""
    extent = cells.agg(F.max("row").alias("rows"), F.max("col").alias("cols"), F.min("row").alias("row0"), F.min("col").alias("col0"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _NEAR])
    spread = cells.select("row", "col", value, F.explode(steps).alias("s")).select((F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), value)
    around = spread.groupBy("row", "col").agg(F.avg(value).alias(value)).join(cells.select("row", "col"), ["row", "col"], "left_anti")
    inside = around.crossJoin(F.broadcast(extent)).filter(F.col("row").between(F.col("row0"), F.col("rows")) & F.col("col").between(F.col("col0"), F.col("cols")))
    return cells.select("row", "col", value, F.lit(False).alias("filled")).unionByName(inside.select("row", "col", value, F.lit(True).alias("filled")))


def metadata(cells: DataFrame, value: str) -> DataFrame:
    grid = (F.max("row") + 1) * (F.max("col") + 1)
    return cells.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.count(value).alias("valid"), (grid - F.count(value)).alias("nodata"))


def dilate(mask: DataFrame, rows: int, cols: int) -> DataFrame:
    """A mask (frame, v, u) grown by the 5 x 5 ellipse and clipped to the image."""
    ellipse = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) < 2 or j == 0]
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ellipse])
    grown = mask.select("frame", "v", "u", F.explode(steps).alias("s")).select("frame", (F.col("v") + F.col("s.i")).alias("v"), (F.col("u") + F.col("s.j")).alias("u"))
    return grown.filter(F.col("v").between(0, rows - 1) & F.col("u").between(0, cols - 1)).distinct()


def half(pixels: DataFrame, mean: str, nearest: str) -> DataFrame:
    """The next level of a pyramid: the mean of 2 x 2 pixels, and the value of the first of them."""
    first = F.max(F.when((F.col("v") % 2 == 0) & (F.col("u") % 2 == 0), F.col(nearest))).alias(nearest)
    return pixels.groupBy("frame", F.floor(F.col("v") / 2).alias("v"), F.floor(F.col("u") / 2).alias("u")).agg(F.avg(mean).alias(mean), first)


def proportions(pixels: DataFrame, classes: DataFrame) -> DataFrame:
    """The share of every class in each frame, 0 included; classes is the dimension table (a few rows)."""
    counts = pixels.groupBy("frame", "cls").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("frame").agg(F.sum("n").alias("total"))
    grid = totals.crossJoin(F.broadcast(classes.select("cls")))
    return grid.join(counts, ["frame", "cls"], "left").select("frame", "cls", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))
