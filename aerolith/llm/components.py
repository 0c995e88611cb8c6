"""Connected components of a large edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm import common

MAX_STEPS = 60


def _lowest(edges: DataFrame) -> DataFrame:
    """u, v, m: each edge with the smallest neighbour of u, or u itself. The minimum is taken before the shuffle where it can be."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(lowest, "u").select("u", "v", F.least("u", "m").alias("m"))


def _pairs(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """u, v of several pairs of columns of each row, in one pass."""
    return rows.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])).alias("p")).select("p.*")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _pairs(edges, ("u", "v"), ("v", "u"))
    return _lowest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return _pairs(_lowest(down), ("v", "m"), ("u", "m")).filter("u <> v")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node of an edge; root is the smallest node of its component."""
    spark = edges.sparkSession
    rows = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    rows, path = common.spill(rows, "edges")
    state = _state(rows)
    for _ in range(MAX_STEPS):
        if not state[0]:
            break
        after, new = common.spill(_small_star(_large_star(rows).distinct()).distinct(), "edges")
        common.discard(spark, path)
        rows, path, before, state = after, new, state, _state(after)
        if state == before:
            break
    else:
        raise RuntimeError("the components didn't settle")
    return rows.select(F.col("u").alias("node"), F.col("v").alias("root")).union(rows.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
