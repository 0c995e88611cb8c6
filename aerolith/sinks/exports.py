"""Text exports as Column and DataFrame expressions, and binary ones of bounded size as bytes.

The columns of a LAS or PLY record are computed in Spark; only the last step, packing
them into bytes, is numpy, a partition at a time.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: LAS codes of the semantic classes 0 to 10.
LAS_CODES = (1, 6, 11, 2, 5, 13, 14, 17, 9, 1, 1)
LAS_RECORD = np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("code", "u1"), ("angle", "i1"), ("state", "u1"), ("source", "<u2"), ("time", "<f8"), ("r", "<u2"), ("g", "<u2"), ("b", "<u2")])
PLY_RECORD = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("nx", "<f4"), ("ny", "<f4"), ("nz", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1"), ("confidence", "<f4"), ("semantic_class", "u1"), ("observation_state", "u1")])


def point_wkt(lon: Column, lat: Column, alt: Column) -> Column:
    return F.concat(F.lit("POINT Z ("), F.concat_ws(" ", lon.cast("string"), lat.cast("string"), alt.cast("string")), F.lit(")"))


def box_wkt(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed ring, in EPSG 4326."""
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return F.concat(F.lit("SRID=4326;POLYGON(("), F.concat_ws(", ", *[F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in corners]), F.lit("))"))


def _fixes(order: str = "t") -> Column:
    """Aggregate: the fixes of a flight in order."""
    return F.array_sort(F.collect_list(F.struct(order, "seq", "lon", "lat", "alt")))


def geojson(fixes: DataFrame) -> DataFrame:
    """flight_id and a FeatureCollection: the track as a line, and a point for each fix; a document holds a flight."""
    box = F.array(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat"))
    rows = fixes.groupBy("flight_id").agg(_fixes().alias("fixes"), box.alias("bbox"))

    def feature(kind: str, coordinates: Column, *properties: Column) -> Column:
        return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")))

    place = lambda p: F.array(p["lon"], p["lat"], p["alt"])
    line = feature("LineString", F.transform("fixes", place), F.col("flight_id").alias("flight"), F.size("fixes").alias("waypoints"))
    points = F.transform("fixes", lambda p: feature("Point", place(p), p["seq"].alias("seq"), p["t"].alias("t")))
    document = F.concat(F.lit('{"type":"FeatureCollection","bbox":'), F.to_json("bbox"), F.lit(',"features":['), F.array_join(F.concat(F.array(line), points), ","), F.lit("]}"))
    return rows.select("flight_id", document.alias("document"))


def czml(fixes: DataFrame) -> DataFrame:
    """flight_id and a CZML document: a header, the path as a polyline (lon, lat, alt, ...), and a packet for each fix."""
    rows = fixes.groupBy("flight_id").agg(_fixes().alias("fixes"))
    flat = F.flatten(F.transform("fixes", lambda p: F.array(p["lon"], p["lat"], p["alt"])))
    path = F.struct(F.concat(F.col("flight_id"), F.lit("_path")).alias("id"), F.struct(F.struct(flat.alias("cartographicDegrees")).alias("positions"), F.lit(False).alias("clampToGround")).alias("polyline"))

    def packet(p: Column) -> Column:
        name = F.concat(F.col("flight_id"), F.lit("_cam_"), F.lpad(p["seq"].cast("string"), 5, "0"))
        degrees = F.struct(F.array(p["lon"], p["lat"], p["alt"]).alias("cartographicDegrees"))
        return F.to_json(F.struct(name.alias("id"), degrees.alias("position"), F.struct(p["seq"].alias("frame_index"), p["t"].alias("timestamp_sec")).alias("properties")))

    body = F.array_join(F.concat(F.array(F.to_json(path)), F.transform("fixes", packet)), ",")
    return rows.select("flight_id", F.concat(F.lit('[{"id":"document","version":"1.0"},'), body, F.lit("]")).alias("document"))


def obj_lines(vertices: DataFrame, faces: DataFrame, normals: DataFrame, uv: DataFrame, material: str = "model") -> DataFrame:
    """place, line of an OBJ file: header, vertices, normals and texture places (vid, ...) in order of vid, then faces; all count from 1."""
    spark = vertices.sparkSession
    head = [f"mtllib {material}.mtl", "usemtl DefaultMaterial"]
    out = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)], "part int, n long, line string").select(F.struct("part", "n").alias("place"), "line")
    for part, tag, rows, columns in ((1, "v", vertices, "xyz"), (2, "vn", normals, ("nx", "ny", "nz")), (3, "vt", uv, "uv")):
        text = F.format_string(" ".join([tag, *["%.6f"] * len(columns)]), *[F.col(c).cast("double") + 0.0 for c in columns])
        out = out.union(rows.select(F.struct(F.lit(part).alias("part"), F.col("vid").cast("long").alias("n")).alias("place"), text.alias("line")))
    corners = [(F.col(c) + 1).cast("long") for c in ("i0", "i1", "i2")]
    text = F.format_string("f %d/%d/%d %d/%d/%d %d/%d/%d", *[c for c in corners for _ in range(3)])
    return out.union(faces.select(F.struct(F.lit(4).alias("part"), F.col("fid").cast("long").alias("n")).alias("place"), text.alias("line")))


def mtl_lines(material: str = "model") -> list[str]:
    """The material of an OBJ file: white, matt, with a texture."""
    return ["newmtl DefaultMaterial", "Ka 1.000 1.000 1.000", "Kd 1.000 1.000 1.000", "Ks 0.000 0.000 0.000", "d 1.0", "illum 2", f"map_Kd {material}_diffuse.png"]


def quantised(depth: Column, scale: float = 1000.0) -> Column:
    """A depth as 16 bits without sign; beyond 65.535 m it saturates at the default scale."""
    return F.least(F.lit(65535), F.greatest(F.lit(0), F.rint(depth * scale))).cast("int")


def las_columns(points: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The integer columns of LAS point records: millimetres from the lowest corner, confidence, code, state, colours; and what is carried."""
    low = points.agg(*[F.min(c).alias(f"__{c}") for c in ("x", "y", "z")])
    code = F.element_at(F.array(*[F.lit(c) for c in LAS_CODES]), F.col("cls") + 1)
    at = [F.rint((F.col(c) - F.col(f"__{c}")) / 0.001).cast("int").alias(c) for c in ("x", "y", "z")]
    colours = [F.shiftleft(F.col(c).cast("int"), 8).alias(c) for c in ("r", "g", "b")]
    intensity = F.rint(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("conf"))) * 65535).cast("int").alias("intensity")
    return points.crossJoin(F.broadcast(low)).select(*carry, *at, intensity, code.alias("code"), F.col("state").cast("int").alias("state"), *colours)


def las_file(records: np.ndarray, low: tuple[float, float, float], high: tuple[float, float, float]) -> bytes:
    """A LAS 1.2 file of point format 3 from its records."""
    n = len(records)
    head = bytearray(227)
    head[0:4], head[24], head[25], head[104] = b"LASF", 1, 2, 3
    head[58:90] = b"aerolith".ljust(32, b"\0")
    struct.pack_into("<HII", head, 94, 227, 227, 0)
    struct.pack_into("<HII", head, 105, LAS_RECORD.itemsize, n, n)
    struct.pack_into("<6d", head, 131, 0.001, 0.001, 0.001, *low)
    struct.pack_into("<6d", head, 179, *[x for pair in zip(high, low, strict=True) for x in pair])
    return bytes(head) + records.tobytes()


def las_bytes(rows: pd.DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> bytes:
    """A LAS file from the columns of las_columns."""
    out = np.zeros(len(rows), LAS_RECORD)
    for c in ("x", "y", "z", "intensity", "code", "state", "r", "g", "b"):
        out[c] = rows[c].to_numpy()
    out["flags"] = out["source"] = 1
    return las_file(out, low, high)


def ply_head(points: int) -> bytes:
    """The header of a binary little-endian PLY file of so many points."""
    kinds = {"f4": "float", "u1": "uchar"}
    lines = [f"property {kinds[PLY_RECORD[c].str[1:]]} {c}" for c in PLY_RECORD.names]
    return "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {points}", *lines, "end_header", ""]).encode()


def ply_bytes(rows: pd.DataFrame) -> bytes:
    """A binary little-endian PLY file."""
    out = np.zeros(len(rows), PLY_RECORD)
    for c in PLY_RECORD.names:
        out[c] = rows[c].to_numpy()
    return ply_head(len(rows)) + out.tobytes()


def tiff_bytes(grid: np.ndarray, x0: float, y1: float, size: float, epsg: int = 4326, nodata: float = -9999.0) -> bytes:
    """A GeoTIFF of one strip of 32-bit floats; NaN becomes NoData."""
    rows, cols = grid.shape
    data = np.where(np.isnan(grid), nodata, grid).astype("<f4").tobytes()
    missing = f"{nodata:g}\0".encode()
    keys = (1, 1, 0, 3, 1024, 0, 1, 1 if epsg > 10000 else 2, 1025, 0, 1, 1, 3072 if epsg > 10000 else 2048, 0, 1, epsg)
    blobs = {33550: struct.pack("<3d", size, size, 0), 33922: struct.pack("<6d", 0, 0, 0, x0, y1, 0), 34735: struct.pack(f"<{len(keys)}H", *keys), 42113: missing}
    short, long_, text, double = 3, 4, 2, 12
    tags = [(256, long_, 1, cols), (257, long_, 1, rows), (258, short, 1, 32), (259, short, 1, 1), (262, short, 1, 1), (273, long_, 1, None), (277, short, 1, 1), (278, long_, 1, rows), (279, long_, 1, len(data)), (284, short, 1, 1), (339, short, 1, 3)]
    tags += [(33550, double, 3, None), (33922, double, 6, None), (34735, short, len(keys), None), (42113, text, len(missing), None)]
    at = 8 + 2 + 12 * len(tags) + 4
    entries, tail = [], b""
    for tag, kind, n, value in tags:
        if tag in blobs:
            value = at + len(tail)
            if len(blobs[tag]) <= 4:
                value = int.from_bytes(blobs[tag].ljust(4, b"\0"), "little")
            else:
                tail += blobs[tag]
        entries.append([tag, kind, n, value])
    for e in entries:
        if e[0] == 273:
            e[3] = at + len(tail)
    return b"II*\0" + struct.pack("<IH", 8, len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0) + tail + data
