"""As-of joins without a range predicate: one union, one sort by key and time.

The rows of both sides are put in one sequence for each key; a window carries the
last row of the right side forward (``backward`` direction) or the next one back
(``forward``). One exchange and one sort, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, tie: str, directions: tuple[str, ...] = ("backward",), prefix: str = "") -> DataFrame:
    """left with structs ``prev`` / ``next``: the right row at or before / at or after each left row.

    Of right rows with equal time the one with the largest ``tie`` precedes; ``tie`` must be a column of right.
    Rows of left stay as they are; without a match the struct is null.
    """
    payload = F.struct(*[F.col(c) for c in right.columns if c not in by])
    kind = payload.alias("r")
    a = left.select(*by, on, F.lit(None).cast(right.select(kind).schema[0].dataType).alias("__r"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.schema[tie].dataType).alias("__tie"))
    b = right.select(*by, on, payload.alias("__r"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.col(tie).alias("__tie"))
    rows = a.union(b)
    is_left = F.when(F.col("__l").isNull(), 0).otherwise(1)
    out = rows
    if "backward" in directions:
        w = Window.partitionBy(*by).orderBy(F.col(on), is_left, "__tie").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("prev", F.last("__r", ignorenulls=True).over(w))
    if "forward" in directions:
        w = Window.partitionBy(*by).orderBy(F.col(on).desc(), is_left, F.col("__tie").desc()).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("next", F.last("__r", ignorenulls=True).over(w))
    return out.filter("__l is not null").select("__l.*", *[c for c in ("prev", "next") if c in out.columns])
