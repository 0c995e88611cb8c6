"""Class masks and detections as tables of pixels (frame, v, u, ...) and boxes (frame, position, x0, y0, x1, y1, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of classes.
UNKNOWN, BUILDING, ROAD, TERRAIN, VEGETATION, VEHICLE, PERSON, UTILITY, WATER, ANIMAL, DYNAMIC_OBJECT = range(11)
#: The colour (red, green, blue) of each class.
PALETTE = ((128, 128, 128), (230, 25, 75), (60, 60, 60), (245, 130, 48), (60, 180, 75), (255, 225, 25), (0, 130, 200), (145, 30, 180), (70, 240, 240), (240, 50, 230), (250, 190, 212))
#: Confidence from which a species is believed, pixels that a component needs, static pixels that an ego-motion needs.
SPECIES_CONFIDENCE = 0.70
LEAST_AREA = 25
LEAST_STATIC = 100
_CORNERS = ("x0", "y0", "x1", "y1")


def combined(semantic: DataFrame, dynamic: DataFrame) -> DataFrame:
    """frame, v, u, cls, dynamic (0 or 255), conf (0 to 255, cut): the channels of a mask from classes (conf 0 to 1) and dynamic pixels."""
    rows = semantic.join(dynamic.select("frame", "v", "u", F.lit(255).alias("dynamic")).distinct(), ["frame", "v", "u"], "left")
    level = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("conf"))) * 255).cast("int")
    return rows.select("frame", "v", "u", "cls", F.coalesce("dynamic", F.lit(0)).alias("dynamic"), level.alias("conf"))


def static_class(cls: Column, dynamic: Column) -> Column:
    """The class of a pixel for static geometry: unknown where it is dynamic."""
    return F.when(dynamic == 255, UNKNOWN).otherwise(cls)


def palette(spark) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(PALETTE)], "cls int, r int, g int, b int")


def coloured(pixels: DataFrame) -> DataFrame:
    """pixels with r, g, b of their class."""
    return pixels.join(F.broadcast(palette(pixels.sparkSession)), "cls")  # eleven rows


def nearest_upsampled(pixels: DataFrame, factor: int) -> DataFrame:
    """Each pixel as factor x factor pixels."""
    step = F.sequence(F.lit(0), F.lit(factor - 1))
    rows = pixels.withColumn("i", F.explode(step)).withColumn("j", F.explode(step))
    return rows.withColumn("v", F.col("v") * factor + F.col("i")).withColumn("u", F.col("u") * factor + F.col("j")).drop("i", "j")


def _clamped(boxes: DataFrame, height: int, width: int) -> DataFrame:
    """Boxes within the image, a pixel wide and high at least; x1 and y1 are beyond the last pixel."""
    for low, high, n in (("x0", "x1", width), ("y0", "y1", height)):
        boxes = boxes.withColumn(low, F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(low))))
        boxes = boxes.withColumn(high, F.greatest(F.col(low) + 1, F.least(F.lit(n), F.col(high))))
    return boxes


def _covered(boxes: DataFrame, height: int, width: int) -> DataFrame:
    """A row for each pixel of each box: at most the image for a box, and joins with pixels are on equal places."""
    boxes = _clamped(boxes, height, width)
    rows = boxes.withColumn("v", F.explode(F.sequence("y0", F.col("y1") - 1))).withColumn("u", F.explode(F.sequence("x0", F.col("x1") - 1)))
    return rows.drop(*_CORNERS)


def _objects(boxes: DataFrame) -> DataFrame:
    """frame, object and the distinct shapes (x0, y0, x1, y1, cls) of the objects: their (frame, position) where several rows share it, else the shape itself.

    Objects of one shape see the same, so that a frame has as many of them as there are shapes, however many boxes.
    """
    kind = [*_CORNERS, "cls"]
    found = boxes.groupBy("frame", "position").agg(F.count(F.lit(1)).alias("rows"), *[F.min(c).alias(c) for c in kind])
    none = [F.lit(None).cast(boxes.schema[c].dataType).alias(c) for c in ("position", *kind)]
    lone = found.filter("rows = 1 and position is not null").select("frame", *kind).distinct().select("frame", F.struct(none[0], *kind).alias("object"), *kind)
    several = boxes.join(found.filter("rows > 1").select("frame", "position"), ["frame", "position"])
    return lone.unionByName(several.select("frame", F.struct("position", *none[1:]).alias("object"), *kind).distinct())


def object_pixels(boxes: DataFrame, pixels: DataFrame, height: int, width: int) -> DataFrame:
    """frame, v, u of the moving objects: in each box the pixels of the object's class, all pixels of the box if there is none."""
    area = _covered(_objects(_clamped(boxes, height, width)), height, width)
    seen = pixels.select("frame", "v", "u", F.col("cls").alias("seen"))
    area = area.join(seen, ["frame", "v", "u"], "left").withColumn("own", F.coalesce(F.col("seen") == F.col("cls"), F.lit(False)))
    any_own = area.groupBy("frame", "object").agg(F.bool_or("own").alias("some"))
    return area.join(any_own, ["frame", "object"]).filter(F.col("own") | ~F.col("some")).select("frame", "v", "u").distinct()


def detection_class(category: Column, species: Column, confidence: Column) -> Column:
    """The class that a detection puts on the mask, null for none; an animal of doubtful species is only a dynamic object."""
    sure = species.isNotNull() & (confidence >= SPECIES_CONFIDENCE)
    return (
        F.when(category == "animal", F.when(sure, ANIMAL).otherwise(DYNAMIC_OBJECT))
        .when(category.isin("moving_region", "dynamic_fallback", "unknown_motion"), DYNAMIC_OBJECT)
        .when(category == "vehicle", VEHICLE)
        .when(category == "person", PERSON)
    )


def overlaid(pixels: DataFrame, detections: DataFrame, height: int, width: int) -> DataFrame:
    """pixels (frame, v, u, cls) with the class of the last detection (position) over them; others keep theirs."""
    top = _covered(detections.filter("cls is not null"), height, width).groupBy("frame", "v", "u").agg(F.max(F.struct("position", "cls")).alias("top"))
    return pixels.join(top, ["frame", "v", "u"], "left").withColumn("cls", F.coalesce("top.cls", "cls")).drop("top")


def ego_motion(flow: DataFrame) -> DataFrame:
    """frame, dx, dy: the median flow of the static pixels, of all pixels if fewer than LEAST_STATIC are static."""
    few = F.count_if("static") < LEAST_STATIC
    over = lambda c: F.when(few, F.median(c)).otherwise(F.median(F.when(F.col("static"), F.col(c))))
    return flow.groupBy("frame").agg(over("dx").alias("dx"), over("dy").alias("dy"))


def contamination(masks: DataFrame, frame_pixels: int) -> DataFrame:
    """One row over frames (objects, dynamic pixels): sums, mean and largest share of a frame, frames with any."""
    share = F.col("pixels") / frame_pixels
    return masks.agg(
        F.sum("objects").alias("objects"), F.sum("pixels").alias("pixels"), F.avg(share).alias("mean_fraction"), F.max(share).alias("max_fraction"), F.count_if(F.col("pixels") > 0).alias("frames")
    )


def mean_distribution(shares: DataFrame) -> DataFrame:
    """cls and the mean of its shares over frames, from the rows of ``rasters.proportions``."""
    return shares.groupBy("cls").agg(F.avg("share").alias("share"))


def _label(rows: pd.DataFrame) -> Iterator[tuple[int, int, int, int, int]]:
    """area, and the box of each 8-connected component, by runs of a row that touch runs of the row before."""
    parent: list[int] = []
    boxes: list[list[int]] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    before: list[tuple[int, int, int]] = []
    last = None
    for v, us in rows.sort_values(["v", "u"]).groupby("v")["u"]:
        runs: list[tuple[int, int, int]] = []
        start = end = None
        for u in [*us.tolist(), None]:
            if end is not None and u == end + 1:
                end = u
                continue
            if end is not None:
                k = len(parent)
                parent.append(k)
                boxes.append([end - start + 1, start, v, end, v])
                for lo, hi, other in before if last == v - 1 else []:
                    if lo <= end + 1 and hi >= start - 1:
                        a, b = sorted((find(k), find(other)))
                        parent[b] = a
                runs.append((start, end, k))
            start = end = u
        before, last = runs, v
    found: dict[int, list[int]] = {}
    for k, (n, x0, y0, x1, y1) in enumerate(boxes):
        b = found.setdefault(find(k), [0, x0, y0, x1, y1])
        found[find(k)] = [b[0] + n, min(b[1], x0), min(b[2], y0), max(b[3], x1), max(b[4], y1)]
    yield from map(tuple, found.values())


def components(pixels: DataFrame, least: int = LEAST_AREA) -> DataFrame:
    """frame, cls, area, x0, y0, x1, y1 of the 8-connected components of each class with ``least`` pixels; a group is one class of an image."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        frame, cls = rows["frame"].iloc[0], rows["cls"].iloc[0]
        found = [(frame, cls, *c) for c in _label(rows.drop_duplicates(["v", "u"])) if c[0] >= least]
        return pd.DataFrame(found, columns=["frame", "cls", "area", "x0", "y0", "x1", "y1"])

    return pixels.select("frame", "cls", "v", "u").groupBy("frame", "cls").applyInPandas(run, "frame long, cls int, area long, x0 long, y0 long, x1 long, y1 long")
