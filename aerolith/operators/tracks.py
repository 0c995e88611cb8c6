"""Object tracks, detections and accuracy."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import rules

HORIZONTAL_TARGET, VERTICAL_TARGET = 0.5, 0.75
CORNERS = ("x0", "y0", "x1", "y1")


def smoothed_motion(rows: DataFrame, key: str, order: list[str], value: str, limit: float) -> DataFrame:
    """rows with ``moving``: whether the mean of the last three values of a track reaches the limit."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-2, 0)
    return rows.withColumn("moving", F.avg(value).over(w) >= limit)


def shapes(boxes: DataFrame, by: str, key: str) -> DataFrame:
    """by, x0, y0, x1, y1 and the keys of all boxes of a frame that lie there; boxes without an area overlap nothing and go.

    Boxes at one place are all pairs of the result among themselves, so that a list of keys is as long as the root of the result at most.
    """
    corners = [F.col("box")[k].alias(c) for k, c in enumerate(CORNERS)]
    return boxes.select(by, F.col(key).alias("key"), *corners).filter("x1 > x0 and y1 > y0 and key is not null").groupBy(by, *CORNERS).agg(F.collect_list("key").alias("keys"))


def overlapping(boxes: DataFrame, by: str, key: str, least: float, size: int = 32, digits: int | None = None) -> DataFrame:
    """a < b and iou (rounded to ``digits``, if given) of the boxes (arrays x0, y0, x1, y1) of a frame that overlap by ``least`` (more than 0).

    Boxes at one place are compared once. They meet in the cells of a grid of this size that both touch; the cell with the corner of
    their overlap counts.
    """
    def cells(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))

    dealt = shapes(boxes, by, key).select("*", F.explode(cells("x0", "x1")).alias("cx")).select("*", F.explode(cells("y0", "y1")).alias("cy"))
    p, q = ([F.col(f"{side}{c}") for c in CORNERS] for side in "pq")
    sides = [dealt.select(by, "cx", "cy", *[F.col(c).alias(f"{side}{c}") for c in (*CORNERS, "keys")]) for side in "pq"]
    corner = [F.floor(F.greatest(p[i], q[i]) / size) for i in range(2)]
    same = ordered = F.lit(True)
    for a, b in zip(reversed(p), reversed(q), strict=True):
        same, ordered = (a == b) & same, (a < b) | ((a == b) & ordered)
    value = rules.iou(p, q)
    met = sides[0].join(sides[1], [by, "cx", "cy"]).filter(ordered & (value >= least) & (F.col("cx") == corner[0]) & (F.col("cy") == corner[1]))
    rounded = value if digits is None else F.bround(value, digits)
    pairs = met.select(by, rounded.alias("iou"), same.alias("same"), "qkeys", F.explode("pkeys").alias("a")).select(by, "iou", "same", "a", F.explode("qkeys").alias("b"))
    a, b, up = F.col("a"), F.col("b"), F.col("up")
    pairs = pairs.withColumn("up", a < b).filter(up | (~F.col("same") & (b < a)))
    return pairs.select(by, F.when(up, a).otherwise(b).alias("a"), F.when(up, b).otherwise(a).alias("b"), "iou")


def accuracy(pairs: DataFrame) -> DataFrame:
    """Root mean squares and maxima of the differences of (ex, ey, ez) and (rx, ry, rz); without pairs zeros and true."""
    dx, dy, dz = (F.col(f"e{c}") - F.col(f"r{c}") for c in ("x", "y", "z"))
    flat = dx * dx + dy * dy
    root = lambda c: F.coalesce(F.sqrt(F.avg(c)), F.lit(0.0))
    out = pairs.agg(root(flat).alias("horizontal"), root(dz * dz).alias("vertical"), root(flat + dz * dz).alias("spatial"), F.coalesce(F.max(F.sqrt(flat)), F.lit(0.0)).alias("worst"))
    return out.withColumn("on_target", (F.col("horizontal") <= HORIZONTAL_TARGET) & (F.col("vertical") <= VERTICAL_TARGET))


def _iou(a: list[float], b: list[float]) -> float:
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def _follow(frames: Iterator[tuple[int, list]], least: float, patience: int) -> Iterator[tuple]:
    """Greedy, in order of age: each track takes its best box that is free; others start tracks."""
    live: dict[int, dict] = {}
    fresh = 1
    for frame, found in frames:
        free = list(range(len(found)))
        for number, t in list(live.items()):
            best = max(free, key=lambda i: (_iou(t["box"], found[i]), -i), default=None)
            t["age"] += 1
            if best is None or _iou(t["box"], found[best]) < least:
                t["missed"] += 1
                if t["missed"] > patience:
                    del live[number]
                continue
            free.remove(best)
            t |= {"box": found[best], "missed": 0, "hits": t["hits"] + 1}
            yield frame, best, number, t["hits"], t["age"]
        for i in free:
            live[fresh] = {"box": found[i], "missed": 0, "hits": 1, "age": 1}
            yield frame, i, fresh, 1, 1
            fresh += 1


def track(detections: DataFrame, least: float = 0.3, patience: int = 5) -> DataFrame:
    """sequence, frame, position, track, hits, age for detections (sequence, frame, position, box), a sequence at a time."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame", "position"])
        groups = [(f, g["box"].tolist(), g["position"].tolist()) for f, g in rows.groupby("frame")]
        names = {f: p for f, _, p in groups}
        out = [(rows["sequence"].iloc[0], f, names[f][i], t, h, a) for f, i, t, h, a in _follow(((f, b) for f, b, _ in groups), least, patience)]
        return pd.DataFrame(out, columns=["sequence", "frame", "position", "track", "hits", "age"])

    return detections.groupBy("sequence").applyInPandas(run, "sequence long, frame long, position long, track long, hits long, age long")


def divergence(flow_u: Column, flow_v: Column, ego_u: Column, ego_v: Column) -> Column:
    """How far an object's flow is from the camera's; 1.5 or more is motion."""
    return F.hypot(flow_u - ego_u, flow_v - ego_v)
