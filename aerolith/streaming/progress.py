"""Progress events as a stream: normalisation, latest state, job states, liveness and windows.

Every function takes a DataFrame that may be a stream or a batch of (job_id, stage,
progress, ts). Windows and watermarks go beyond what batch callers need.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.operators import scratch

#: States of a job in their order; the last three end it.
STATES = ("QUEUED", "VALIDATING", "EXTRACTING_FRAMES", "ESTIMATING_POSE", "ESTIMATING_DEPTH", "SEGMENTING", "FUSING", "RECONSTRUCTING", "TEXTURING", "GEOREFERENCING", "QUALITY_CHECK", "GENERATING_TILES", "COMPLETED", "FAILED", "CANCELLED")
TERMINAL = STATES[-3:]


def normalise(raw: Column) -> Column:
    """A struct from the JSON of an event; text that isn't JSON comes under ``raw``."""
    e = F.from_json(raw, "struct<job_id:string,stage:string,progress:double,frames_processed:bigint,total_frames:bigint,frames_total:bigint,gpu_utilization:double,gpu_stats:struct<utilization:double,vram_used:double>,updated_at:string,warnings:array<string>>", {"columnNameOfCorruptRecord": "_bad"})
    bad = e.isNull() | (e["job_id"].isNull() & e["stage"].isNull())
    return F.struct(
        e["job_id"].alias("job_id"),
        F.coalesce(e["stage"], F.lit("")).alias("stage"),
        F.coalesce(e["progress"], F.lit(0.0)).alias("progress"),
        F.coalesce(e["frames_processed"], F.lit(0)).alias("frames_processed"),
        F.coalesce(e["total_frames"], e["frames_total"], F.lit(0)).alias("frames_total"),
        F.coalesce(e["gpu_utilization"], e["gpu_stats"]["utilization"], F.lit(0.0)).alias("gpu_utilization"),
        F.coalesce(e["warnings"], F.array().cast("array<string>")).alias("warnings"),
        F.when(bad, raw).alias("raw"),
    )


def tumbling(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    return _windowed(events, late, F.window("ts", width))


def sliding(events: DataFrame, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    return _windowed(events, late, F.window("ts", width, step))


def _windowed(events: DataFrame, late: str, window: Column) -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(window.alias("w"), "stage").agg(F.count(F.lit(1)).alias("n"), F.max("progress").alias("progress"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "stage", "n", "progress")


def sessions(beats: DataFrame, gap: str = "15 seconds", late: str = "10 minutes") -> DataFrame:
    """Spells of a worker in which no beat is later than gap after the one before."""
    rows = beats.withWatermark("ts", late).groupBy("job_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("beats"))
    return rows.select("job_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")


def once(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first message of each job: what comes again within the watermark is dropped."""
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id"])


#: Parts of the table of latest events.
BUCKETS = 64


def _committed(spark: SparkSession, path: str, before: int | None = None) -> dict[str, int]:
    """Bucket -> the epoch that wrote it, as the last commit (before an epoch) says."""
    epochs = [int(n) for n in scratch.children(spark, f"{path}/_log")]
    epochs = [e for e in epochs if before is None or e < before]
    return json.loads(spark.read.text(f"{path}/_log/{max(epochs)}").first()[0]) if epochs else {}


def _paths(path: str, parts: dict[str, int]) -> list[str]:
    return [f"{path}/data/epoch={e}/bucket={b}" for b, e in sorted(parts.items())]


def upsert_latest(path: str, buckets: int = BUCKETS):
    """For foreachBatch: keeps a table with the latest event of each job.

    A micro-batch writes the buckets that its jobs fall into and no others, then a commit that names the epoch of each
    bucket. One that comes again starts from the commit before it and changes nothing; epochs that neither the last
    commit nor the one before names are deleted. ``read_latest`` reads what was committed last.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        parts = _committed(spark, path, epoch)
        bucket = F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")
        rows = batch.select("job_id", "stage", "progress", "ts", bucket.alias("bucket")).persist()
        touched = {str(r[0]) for r in rows.select("bucket").distinct().collect()}  # one for each bucket at most
        old = {b: e for b, e in parts.items() if b in touched}
        both = rows.unionByName(spark.read.option("basePath", f"{path}/data").parquet(*_paths(path, old)).select(*rows.columns)) if old else rows
        top = both.groupBy("job_id", "bucket").agg(F.max(F.struct("ts", "progress", "stage")).alias("m"))
        if touched:
            top.select("job_id", "m.stage", "m.progress", "m.ts", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/epoch={epoch}")
        rows.unpersist()
        commit = parts | dict.fromkeys(touched, epoch)
        spark.createDataFrame([(json.dumps(commit),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_log/{epoch}")
        wanted = {f"epoch={e}" for e in {*parts.values(), *commit.values()}}
        scratch.delete(spark, *[f"{path}/data/{n}" for n in scratch.children(spark, f"{path}/data") if n not in wanted and int(n[6:]) < epoch])
        scratch.delete(spark, *[f"{path}/_log/{n}" for n in scratch.children(spark, f"{path}/_log") if int(n) < epoch - 1])

    return run


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """job_id, stage, progress, ts as the last commit left them."""
    parts = _committed(spark, path)
    if not parts:
        return spark.createDataFrame([], "job_id long, stage string, progress double, ts timestamp")
    return spark.read.option("basePath", f"{path}/data").parquet(*_paths(path, parts)).select("job_id", "stage", "progress", "ts")


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job after its events, with a count of events refused: states only go forward, and the last three stay."""
    rank = {s: i for i, s in enumerate(STATES)}

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        current, refused = state.get if state.exists else ("QUEUED", 0)
        rows = pd.concat(list(parts)).sort_values("ts")
        for stage in rows["stage"]:
            ok = current not in TERMINAL and stage in rank and (stage in ("FAILED", "CANCELLED") or rank[stage] >= rank[current])
            current, refused = (stage, refused) if ok else (current, refused + 1)
        state.update((current, refused))
        yield pd.DataFrame({"job_id": [key[0]], "state": [current], "refused": [refused]})

    return events.groupBy("job_id").applyInPandasWithState(run, "job_id long, state string, refused long", "state string, refused long", "update", "NoTimeout")
