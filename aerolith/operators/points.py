"""Point clouds: fusion by voxel, down-sampling, neighbours on a grid, outliers and states.

Neighbour searches join on grid cells, never on a distance: each point looks in its
own cell and the 26 around it, so that the join is an equi-join that Spark partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.operators.scratch import Workspace

AXES = ("x", "y", "z")


def cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) * (1 / size)).cast("long")


def fuse(points: DataFrame, voxel: float, min_single: int = 60) -> DataFrame:
    """One point for each voxel: weighted means, best confidence, weightiest class (lowest on a tie), number of frames.

    Weights are whole percents of confidence, 1 at least, so that sums don't depend on their order. A voxel seen by a
    single frame needs ``min_single`` percent. Levels of aggregation by (voxel, class, frame), (voxel, class) and voxel, all
    with partial sums, so that no list of frames is gathered.
    """
    keys = [cell(c, voxel).alias(f"v{c}") for c in AXES]
    w = F.greatest(F.lit(1), F.col("conf_pct")).cast("long")
    by_class = points.select("*", *keys, w.alias("w")).groupBy("vx", "vy", "vz", "cls", "frame").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(c)).alias(f"s{c}") for c in AXES], F.max("conf_pct").alias("conf_pct"))
    by_frame = by_class.groupBy("vx", "vy", "vz", "frame").agg(F.lit(1).alias("one")).groupBy("vx", "vy", "vz").agg(F.count(F.lit(1)).alias("views"))
    by_class = by_class.groupBy("vx", "vy", "vz", "cls").agg(F.sum("w").alias("w"), *[F.sum(f"s{c}").alias(f"s{c}") for c in AXES], F.max("conf_pct").alias("conf_pct"))
    fused = by_class.groupBy("vx", "vy", "vz").agg(*[(F.sum(f"s{c}") / F.sum("w")).alias(c) for c in AXES], F.max("conf_pct").alias("conf_pct"), F.max(F.struct("w", -F.col("cls"))).alias("top"))
    fused = fused.join(by_frame, ["vx", "vy", "vz"])
    return fused.select("vx", "vy", "vz", *AXES, "conf_pct", (-F.col("top.col2")).alias("cls"), "views").filter((F.col("views") > 1) | (F.col("conf_pct") >= min_single))


def down_sample(points: DataFrame, voxel: float, order: list[str]) -> DataFrame:
    """The first point of each voxel."""
    first = F.min(F.struct(*order, *[c for c in points.columns if c not in order])).alias("p")
    return points.groupBy(*[cell(c, voxel).alias(f"v{c}") for c in AXES]).agg(first).select("p.*")


def _around(points: DataFrame, size: float) -> DataFrame:
    """points once for each cell in which a neighbour within size may lie."""
    near = F.sequence(F.lit(-1), F.lit(1))
    out = points
    for c in AXES:
        out = out.withColumn(f"c{c}", F.explode(F.transform(near, lambda k: k + cell(c, size))))  # noqa: B023
    return out


def _places(points: DataFrame) -> DataFrame:
    """The distinct places of points and the number of points at each, which stand for one another in neighbour searches."""
    return points.groupBy(*AXES).agg(F.count(F.lit(1)).alias("m"))


def _near_places(open_places: DataFrame, places: DataFrame, radius: float) -> DataFrame:
    """x, y, z, d, m for the places within radius of each open place; a point isn't among the m points at its own place."""
    a = _around(open_places.select(*AXES), radius)
    b = places.select("m", *[F.col(c).alias(f"o{c}") for c in AXES], *[cell(c, radius).alias(f"c{c}") for c in AXES])
    near = a.join(b, [f"c{c}" for c in AXES]).withColumn("d2", _apart()).filter(F.col("d2") <= radius * radius)
    return near.select(*AXES, F.sqrt("d2").alias("d"), (F.col("m") - (F.col("d2") == 0).cast("long")).alias("m")).filter("m > 0")


def _apart() -> Column:
    return sum((F.pow(F.col(c) - F.col(f"o{c}"), 2) for c in AXES[1:]), F.pow(F.col("x") - F.col("ox"), 2))


#: One of each two opposite cells around a cell, and the cell itself first.
_HALF = [(0, 0, 0)] + [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]


def radius_inliers(points: DataFrame, radius: float, least: int) -> DataFrame:
    """Points with ``least`` other points within radius, and their number; the pairs are those of places, not of points.

    Each place looks into half of the cells around its own, and a pair counts for both of its places.
    """
    with Workspace(points.sparkSession) as w:
        places = w.cut(_places(points), "places")
        steps = F.array(*[F.struct(*[F.lit(s).alias(f"s{c}") for c, s in zip(AXES, step, strict=True)]) for step in _HALF])
        a = places.withColumn("s", F.explode(steps)).select("m", *AXES, ((F.col("s.sx") != 0) | (F.col("s.sy") != 0) | (F.col("s.sz") != 0)).alias("beside"), *[(cell(c, radius) + F.col(f"s.s{c}")).alias(f"c{c}") for c in AXES])
        b = places.select(F.col("m").alias("om"), *[F.col(c).alias(f"o{c}") for c in AXES], *[cell(c, radius).alias(f"c{c}") for c in AXES])
        near = a.join(b, [f"c{c}" for c in AXES]).withColumn("d2", _apart()).filter(F.col("d2") <= radius * radius)
        mine = F.struct(*AXES, (F.col("om") - (F.col("d2") == 0).cast("long")).alias("n"))
        other = F.struct(*[F.col(f"o{c}").alias(c) for c in AXES], F.col("m").alias("n"))
        both = near.select(F.explode(F.when(F.col("beside"), F.array(mine, other)).otherwise(F.array(mine))).alias("p"))
        counts = both.groupBy(*[F.col(f"p.{c}").alias(c) for c in AXES]).agg(F.sum("p.n").alias("neighbours")).filter(F.col("neighbours") >= least)
        return points.join(w.keep(counts, "neighbours"), list(AXES))


def neighbour_distance(points: DataFrame, k: int, size: float) -> DataFrame:
    """x, y, z and the mean distance of a point there to its k nearest others, written.

    The search doubles its radius for the places that have fewer than k others within it; a place with k within the radius
    is settled, as everything outside is farther. It ends when none is open, or when the radius spans all points: what is
    open then has fewer than k others at all, and gets a null.
    """
    with Workspace(points.sparkSession) as w:
        places, done, radius = w.cut(_places(points), "places"), None, size
        span = F.sqrt(sum((F.pow(F.max(c) - F.min(c), 2) for c in AXES[1:]), F.pow(F.max("x") - F.min("x"), 2)))
        widest = places.agg(span).first()[0] or 0.0
        open_places = places
        order = Window.partitionBy(*AXES).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
        while True:
            taken = F.greatest(F.lit(0), F.least(F.col("m"), k - (F.sum("m").over(order) - F.col("m"))))
            near = _near_places(open_places, places, radius).withColumn("taken", taken)
            found = near.groupBy(*AXES).agg((F.sum(F.col("taken") * F.col("d")) / k).alias("mean_d"), F.sum("taken").alias("n")).filter(F.col("n") == k).drop("n")
            found = w.cut(found, "found")
            done = found if done is None else done.unionByName(found)
            open_places = w.cut(open_places.join(found, list(AXES), "left_anti"), "open")
            if open_places.isEmpty():
                return w.keep(done, "distances")
            if radius > widest:
                return w.keep(done.unionByName(open_places.select(*AXES, F.lit(None).cast("double").alias("mean_d"))), "distances")
            radius *= 2


def statistical_inliers(points: DataFrame, k: int, size: float, ratio: float) -> DataFrame:
    """Points whose mean neighbour distance is at most mean + ratio * deviation over all points (one row, broadcast)."""
    rows = points.join(neighbour_distance(points, k, size), list(AXES))
    limit = rows.agg((F.avg("mean_d") + ratio * F.stddev_pop("mean_d")).alias("limit"))
    return rows.crossJoin(F.broadcast(limit)).filter(F.col("mean_d") <= F.col("limit")).drop("limit")


def outside_boxes(points: DataFrame, boxes: list[tuple[float, ...]], classes: list[int]) -> DataFrame:
    """Points in none of the boxes (x0, y0, z0, x1, y1, z1), closed, and of none of the classes."""
    inside = F.lit(False)
    for b in boxes:
        hit = F.lit(True)
        for i, c in enumerate(AXES):
            hit = hit & F.col(c).between(b[i], b[i + 3])
        inside = inside | hit
    return points.filter(~inside & ~F.col("cls").isin(classes))


def nearest_other(points: DataFrame, others: DataFrame, size: float) -> DataFrame:
    """x, y, z of the distinct places of points, with the id and the distance of the nearest of ``others`` (id, x, y, z; the lowest id on a tie).

    Of others at one place only the lowest id can be the nearest. As in ``neighbour_distance``, the radius doubles for the places that have none within it;
    without others there is no row. The result is written.
    """
    with Workspace(points.sparkSession) as w:
        open_places, done, radius = w.cut(points.select(*AXES).distinct(), "places"), None, size
        others = w.cut(others.groupBy(*AXES).agg(F.min("id").alias("id")), "others")
        if others.isEmpty():
            return points.select(*AXES).limit(0).select("*", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("d"))
        while True:
            b = others.select("id", *[F.col(c).alias(f"o{c}") for c in AXES], *[cell(c, radius).alias(f"c{c}") for c in AXES])
            near = _around(open_places, radius).join(b, [f"c{c}" for c in AXES]).withColumn("d2", _apart()).filter(F.col("d2") <= radius * radius)
            found = w.cut(near.groupBy(*AXES).agg(F.min(F.struct("d2", "id")).alias("m")).select(*AXES, F.col("m.id").alias("id"), F.sqrt("m.d2").alias("d")), "found")
            done = found if done is None else done.unionByName(found)
            open_places = w.cut(open_places.join(found, list(AXES), "left_anti"), "open")
            if open_places.isEmpty():
                return w.keep(done, "nearest")
            radius *= 2


def filter_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: points before and after filters, removed, and the share retained in percent (0 of none)."""
    counts = before.agg(F.count(F.lit(1)).alias("input")).crossJoin(F.broadcast(after.agg(F.count(F.lit(1)).alias("output"))))
    share = F.when(F.col("input") > 0, 100.0 * F.col("output") / F.col("input")).otherwise(0.0)
    return counts.select("input", "output", (F.col("input") - F.col("output")).alias("removed"), share.alias("retained"))
