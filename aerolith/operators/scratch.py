"""Written intermediate tables: where a lineage is cut, and what is deleted afterwards."""

from __future__ import annotations

import uuid
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession

#: Only used where the session names no folder and runs on one machine, as in tests.
LOCAL = "file:///tmp/checkpoints/aerolith"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; on a cluster the session must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return LOCAL


class Workspace:
    """``with Workspace(spark) as w``: tables written by w.cut are deleted at its end, those by w.keep stay for lazy results."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        delete(self.spark, *self.paths)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return self._written(df, name)[0]

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        table, path = self._written(df, name)
        self.paths.append(path)
        return table

    def _written(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
