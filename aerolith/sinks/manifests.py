"""Keys, manifests and JSON documents of a job's results; a document holds what belongs to one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Geometric errors of a tileset, its root and its tiles.
TILESET_ERROR, ROOT_ERROR, TILE_ERROR = 64.0, 48.0, 12.0


def storage_key(job: Column, folder: str, stem: str, index: Column, suffix: str) -> Column:
    return F.format_string(f"jobs/%s/interim/{folder}/{stem}_%05d.{suffix}", job.cast("string"), index.cast("long"))


def merged(document: str, name: str, part: Column) -> Column:
    """A JSON object with one more member at its end."""
    body = F.regexp_replace(F.coalesce(F.col(document), F.lit("{}")), r"\}\s*$", "")
    comma = F.when(F.rtrim(body).endswith("{"), "").otherwise(",")
    return F.concat(body, comma, F.lit(f'"{name}":'), F.to_json(part), F.lit("}"))


def cameras(rows: DataFrame, job: str, order: str) -> DataFrame:
    """job, document from rows of job and a struct ``camera``."""
    found = rows.groupBy(job).agg(F.array_sort(F.collect_list("camera")).alias("cameras"))
    return found.select(job, F.to_json(F.struct(F.col(job), F.size("cameras").alias("total_cameras"), "cameras")).alias("document"))


def tileset(tiles: DataFrame, job: str) -> DataFrame:
    """job, document from tiles (job, tile, faces)."""
    child = F.struct(F.struct(F.concat(F.lit("tile_"), F.col("tile"), F.lit(".glb")).alias("uri")).alias("content"), F.lit(TILE_ERROR).alias("geometricError"), "faces")
    rows = tiles.groupBy(job).agg(F.transform(F.array_sort(F.collect_list(F.struct("tile", child.alias("node")))), lambda t: t["node"]).alias("children"))
    root = F.struct(F.struct(F.lit("tile_root.glb").alias("uri")).alias("content"), F.lit(ROOT_ERROR).alias("geometricError"), F.lit("REPLACE").alias("refine"), "children")
    return rows.select(job, F.to_json(F.struct(F.struct(F.lit("1.1").alias("version")).alias("asset"), F.lit(TILESET_ERROR).alias("geometricError"), root.alias("root"))).alias("document"))


def manifest(files: DataFrame, job: str, order: str) -> DataFrame:
    """job, files, bytes and a digest over the SHA-256 of each file's content in order."""
    rows = files.select(job, F.struct(order, F.sha2("content", 256).alias("sha")).alias("f"), F.octet_length("content").alias("size"))
    digests = F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["sha"]), "")
    return rows.groupBy(job).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sha2(digests, 256).alias("digest"))
