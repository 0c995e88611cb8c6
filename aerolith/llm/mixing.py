"""Mixing sources to target weights, in DataFrame operations only.

The size of a document is its number of words. Sources, sorted by code point with
null last, weigh 3, 1, 2, 3, 1, 2, ... and share ``share`` times all sizes; a target
stops at ``ceiling`` times its source's size, and the excess goes by weight to the
others until none is above. That fixed point is a water level: a source gets
``min(ceiling * size, level * weight)``. With the sources in the order in which they fill
up, prefix sums give the level that holds if exactly the first k are full; it rises with
k while the next source is full too and falls afterwards, so that the largest is right.

A source's repetition rate is target / size. Each document comes floor(rate) times,
plus once more with probability rate - floor(rate), drawn from an MD5 of the seed and
doc_id, so that reruns and retries agree.

The source table has one row for each source; its size is counted before it is
broadcast, and beyond ``broadcast_rows`` sources it is joined by shuffle with the
source key salted. Defined cases: null text has size 0; a source of size 0 has
target 0 and rate 0; null doc_ids share one draw, and so do repeated rows, each of which
counts; a text of any length is counted in one pass; an empty table gives no rows; extra
columns are carried by ``mix``, whatever their names, and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2.0
SEED = "mix"
BROADCAST_ROWS = 50_000
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from an MD5 of the seed and doc_id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """source, source_size, target from a table of source and size."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (
        ranked.withColumn("weight", weight)
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level", (F.col("total") - F.lit(ceiling) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", F.least(F.lit(ceiling) * F.col("source_size"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))
    )


def copies(doc_id: Column, target: Column, source_size: Column, seed: str = SEED) -> Column:
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return (whole + F.when(uniform(doc_id, seed) < rate - whole, 1).otherwise(0)).cast("long")


def _with_targets(rows: DataFrame, plan: DataFrame, broadcast_rows: int) -> tuple[DataFrame, str, str]:
    """rows with the size and the target of their source, and the names of these two columns."""
    source, size, target, salt, own = names = [common.unused(rows.columns, c) for c in ("of_source_", "source_size_", "target_", "salt_", "own_salt_")]
    plan = plan.select(F.col("source").alias(source), F.col("source_size").alias(size), F.col("target").alias(target))
    on = F.col("source").eqNullSafe(F.col(source))
    if plan.count() <= broadcast_rows:
        return rows.join(F.broadcast(plan), on, "left"), *names[1:3]
    salted = plan.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn(own, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, on & (F.col(own) == F.col(salt)), "left"), *names[1:3]


def mix_report(docs: DataFrame, share: float = SHARE, ceiling: float = CEILING, seed: str = SEED, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    sizes = common.spill(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")[0]
    plan = common.spill(targets(sizes, share, ceiling), "targets")[0]
    rows, source_size, target = _with_targets(sizes, plan, broadcast_rows)
    n = copies(F.col("doc_id"), F.col(target), F.col(source_size), seed)
    return rows.select("doc_id", "size", F.col(source_size).alias("source_size"), F.col(target).alias("target"), (n * F.col("size")).alias("taken"))


def mix(docs: DataFrame, share: float = SHARE, ceiling: float = CEILING, seed: str = SEED, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with each row as often as the mix takes it; the same columns."""
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    plan = common.spill(targets(sizes, share, ceiling), "targets")[0]
    rows, source_size, target = _with_targets(docs, plan, broadcast_rows)
    n = copies(F.col("doc_id"), F.col(target), F.col(source_size), seed)
    return rows.withColumn(common.unused(rows.columns, "copy_"), F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*docs.columns)
