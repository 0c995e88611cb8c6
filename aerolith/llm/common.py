"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Only used where the session names no shared folder, as in tests.
DEFAULT_SHARED = "file:///tmp/checkpoints/aerolith"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share."""
    return spark.conf.get("spark.checkpoint.dir", None) or DEFAULT_SHARED


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spill(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    if _SPILLS:
        _SPILLS[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths written inside each open workspace, innermost last.
_SPILLS: list[list[str]] = []


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes the tables written inside at its end. It gives a function that writes a result, which stays: a lazy one may read what is deleted.

    What is executed inside gives its shuffle files up as it ends; else they stay until the driver collects its garbage.
    """
    _SPILLS.append([])
    kept: list[str] = []
    before = spark.conf.get(SHUFFLES_END, "false")
    spark.conf.set(SHUFFLES_END, "true")

    def result(df: DataFrame, name: str) -> DataFrame:
        table, path = spill(df, name)
        kept.append(path)
        return table

    try:
        yield result
    finally:
        spark.conf.set(SHUFFLES_END, before)
        written = _SPILLS.pop()
        if _SPILLS:
            _SPILLS[-1].extend(kept)
        discard(spark, *(p for p in written if p not in kept))


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no later result reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def extended(schema: T.StructType, **columns: str) -> T.StructType:
    """A copy of schema with more columns, given as name=type."""
    out = T.StructType(list(schema.fields))
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out


def unused(names: list[str], stem: str) -> str:
    """A column name like stem that isn't among names, in any case of letters."""
    taken = {n.lower() for n in names}
    while stem.lower() in taken:
        stem += "_"
    return stem


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of this many rows at most for what is executed inside; the session's setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
