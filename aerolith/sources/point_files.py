"""Point clouds as LAS and PLY files: a Spark data source that plans its partitions and commits what it writes.

    spark.dataSource.register(PointFiles)
    cloud.write.format("points").option("kind", "las").mode("append").save("file:///clouds/a")
    spark.read.format("points").load("file:///clouds/a")

A task writes files of at most ``POINTS`` points under names of its own; a manifest, put in place as one file at the end of
the job, names those that count, with their points, bytes and SHA-256. Files of a failed attempt are
never named and are deleted, so that a point is there once or not at all. Records have a fixed length, so that a read is cut into ranges of records
that tasks fetch on their own. Paths go through pyarrow's file systems, on the driver and on executors.

LAS keeps coordinates to a millimetre from the lowest corner of each file, PLY as 32-bit floats. Points with a null in
a column that a format keeps are refused with an error; columns that it doesn't keep are left out.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from aerolith.sinks.exports import LAS_CODES, LAS_RECORD, PLY_RECORD, las_file, ply_head

POINTS = 1_000_000
#: Records that a task reads.
RANGE = 4_000_000
MANIFEST = "_manifest.json"
LAS_HEADER = 227
SCHEMAS = {
    "las": "x double, y double, z double, conf double, code int, state int, r int, g int, b int",
    "ply": "x float, y float, z float, nx float, ny float, nz float, r int, g int, b int, conf float, cls int, state int",
}
WRITTEN = {"las": ("x", "y", "z", "conf", "cls", "state", "r", "g", "b"), "ply": ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "conf", "cls", "state")}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def manifest(path: str) -> dict:
    """The manifest of a folder: kind and files; without one there are no files."""
    system, at = _open(path)
    name = posixpath.join(at, MANIFEST)
    if system.get_file_info(name).type == fs.FileType.NotFound:
        return {"kind": None, "files": []}
    with system.open_input_stream(name) as f:
        return json.loads(f.read())


def las_records(rows: dict[str, np.ndarray]) -> bytes:
    low = [float(rows[c].min()) for c in "xyz"]
    high = [float(rows[c].max()) for c in "xyz"]
    out = np.zeros(len(rows["x"]), LAS_RECORD)
    for c, start in zip("xyz", low, strict=True):
        out[c] = np.rint((rows[c] - start) / 0.001)
    out["intensity"] = np.rint(np.clip(rows["conf"], 0, 1) * 65535)
    codes = np.array(LAS_CODES)
    cls = rows["cls"].astype(int)
    out["code"] = np.where((cls >= 0) & (cls < len(codes)), codes[np.clip(cls, 0, len(codes) - 1)], 1)
    out["state"] = rows["state"]
    for c in "rgb":
        out[c] = rows[c].astype(np.uint16) << 8
    out["flags"] = out["source"] = 1
    return las_file(out, tuple(low), tuple(high))


def ply_records(rows: dict[str, np.ndarray]) -> bytes:
    out = np.zeros(len(rows["x"]), PLY_RECORD)
    names = dict(zip(("r", "g", "b", "conf", "cls", "state"), ("red", "green", "blue", "confidence", "semantic_class", "observation_state"), strict=True))
    for c in WRITTEN["ply"]:
        out[names.get(c, c)] = rows[c]
    return ply_head(len(out)) + out.tobytes()


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class PointWriter(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, names: list[str], overwrite: bool, points: int):
        self.path, self.kind, self.overwrite, self.points = path, kind, overwrite, points
        if missing := [c for c in WRITTEN[kind] if c not in names]:
            raise ValueError(f"a {kind} file needs the columns {', '.join(missing)}")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = _open(self.path)
        system.create_dir(at, recursive=True)
        files: list[dict] = []
        held, count = [], 0

        def flush() -> None:
            table = pa.Table.from_batches(held)
            for c in WRITTEN[self.kind]:
                if table.column(c).null_count:
                    raise ValueError(f"{c} is null in {table.column(c).null_count} points")
            data = (las_records if self.kind == "las" else ply_records)({c: table.column(c).to_numpy() for c in WRITTEN[self.kind]})
            name = f"part-{self.job}-{uuid.uuid4().hex}.{self.kind}"
            with system.open_output_stream(posixpath.join(at, name)) as f:
                f.write(data)
            files.append({"name": name, "points": table.num_rows, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})

        for batch in iterator:
            while batch.num_rows:
                some = batch.slice(0, self.points - count)
                held.append(some)
                count += some.num_rows
                batch = batch.slice(some.num_rows)
                if count == self.points:
                    flush()
                    held, count = [], 0
        if count:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = _open(self.path)
        system.create_dir(at, recursive=True)
        before = manifest(self.path)
        new = sorted((f for m in messages if m for f in m.files), key=lambda f: f["sha256"])
        if before["files"] and before["kind"] != self.kind and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} holds {before['kind']} files")
        files = new if self.overwrite else before["files"] + new
        with system.open_output_stream(posixpath.join(at, f"{MANIFEST}.{self.job}")) as f:
            f.write(json.dumps({"kind": self.kind, "files": files}).encode())
        system.move(posixpath.join(at, f"{MANIFEST}.{self.job}"), posixpath.join(at, MANIFEST))
        self._clean(system, at, {f["name"] for f in files}, self.overwrite)

    def abort(self, messages: list[Written | None]) -> None:
        system, at = _open(self.path)
        self._clean(system, at, set(), False)

    def _clean(self, system: fs.FileSystem, at: str, named: set[str], all_jobs: bool) -> None:
        """Delete files of this job (or, once overwritten, of any) that the manifest doesn't name."""
        for info in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            name = info.base_name
            if name.startswith("part-" if all_jobs else f"part-{self.job}-") and name not in named:
                system.delete_file(info.path)


@dataclass
class Records(InputPartition):
    name: str
    start: int
    count: int


class PointReader(DataSourceReader):
    def __init__(self, path: str, kind: str, records: int):
        self.path, self.kind, self.records = path, kind, records

    def partitions(self) -> list[Records]:
        return [Records(f["name"], at, min(self.records, f["points"] - at)) for f in manifest(self.path)["files"] for at in range(0, f["points"], self.records)] or [Records("", 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        system, at = _open(self.path)
        record = LAS_RECORD if self.kind == "las" else PLY_RECORD
        with system.open_input_file(posixpath.join(at, partition.name)) as f:
            head = f.read_at(1024, 0)
            start = LAS_HEADER if self.kind == "las" else head.index(b"end_header\n") + len(b"end_header\n")
            for k in range(partition.start, partition.start + partition.count, 1 << 16):
                n = min(1 << 16, partition.start + partition.count - k)
                rows = np.frombuffer(f.read_at(n * record.itemsize, start + k * record.itemsize), record)
                yield self._batch(rows, head)

    def _batch(self, rows: np.ndarray, head: bytes) -> pa.RecordBatch:
        if self.kind == "las":
            scale, low = np.frombuffer(head, "<f8", 3, 131), np.frombuffer(head, "<f8", 3, 155)
            columns = {c: rows[c] * scale[k] + low[k] for k, c in enumerate("xyz")}
            columns |= {"conf": rows["intensity"] / 65535.0, "code": rows["code"].astype(np.int32), "state": rows["state"].astype(np.int32)}
            columns |= {c: (rows[c] >> 8).astype(np.int32) for c in "rgb"}
        else:
            columns = {c: rows[c] for c in ("x", "y", "z", "nx", "ny", "nz")}
            columns |= {c: rows[n].astype(np.int32) for c, n in zip("rgb", ("red", "green", "blue"), strict=True)}
            columns |= {"conf": rows["confidence"], "cls": rows["semantic_class"].astype(np.int32), "state": rows["observation_state"].astype(np.int32)}
        return pa.record_batch({c: pa.array(np.ascontiguousarray(v)) for c, v in columns.items()})


class PointFiles(DataSource):
    """Options: path; kind (las or ply; when reading, the manifest's); points of a file at most; records of a read partition at most."""

    @classmethod
    def name(cls) -> str:
        return "points"

    def _kind(self) -> str:
        kind = self.options.get("kind") or manifest(self.options["path"])["kind"] or "las"
        if kind not in SCHEMAS:
            raise ValueError(f"kind must be one of {', '.join(SCHEMAS)}")
        return kind

    def schema(self) -> str:
        return SCHEMAS[self._kind()]

    def reader(self, schema: StructType) -> PointReader:
        return PointReader(self.options["path"], self._kind(), int(self.options.get("records", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> PointWriter:
        return PointWriter(self.options["path"], self._kind(), schema.names, overwrite, int(self.options.get("points", POINTS)))
