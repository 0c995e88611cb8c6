"""Token files: whole texts as token ids, entropy-coded with one shared table.

``write`` makes a dataset of three tables in one folder:

* ``table``: one row with the frequency table (``rans.Table``), from the counts of all
  ids of all documents;
* ``segments``: rows (part, seq, start, ids, blob), where each blob is a binary segment
  of ``rans`` with some ``SEGMENT`` ids of whole documents. Parts follow one another in
  ascending doc_id order (null first), as do the segments of a part; start counts the
  ids before it in its part.

Parquet is only the container, so that Spark's committer makes each part appear whole
or not at all on any file system; blobs don't depend on it. ``read`` decodes every
segment by itself, the checkpoint parts of a block side by side, and gives each document
its place among all ids. Texts are encoded
once, into a table of ids that is deleted after the segments are written. Defined
cases: null text is empty and has the end id alone; repeated rows are stored each for
itself, in one part if their doc_id is the same, as are all rows without doc_id; a text of any
length lies in one segment, over as many blocks as it needs; an empty table gives files
with no segment; extra columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.llm import common, rans
from aerolith.llm.tokenize import Encoder, shared_encoder

VOCABULARY = "word_bpe_49k.json"
END = 1
SEGMENT = 1 << 20
PART_IDS = 8 << 20
#: Rows of an Arrow batch of texts or ids: a worker and its executor hold a batch several times over.
TEXT_ROWS = 1_000
PARTS_A_BLOCK = 4096
BROADCAST_PARTS = 1_000_000
_COUNTS = pa.list_(pa.struct([("token", pa.int32()), ("n", pa.int64())]))


def _encode_pass(path: str, end: int):
    """A row of ids for each document, and a last row with the task's counts of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        counts = np.zeros(max(encoder.size, end + 1), np.int64)
        tail = np.array([end], encoder.dtype).tobytes()
        for batch in batches:
            ids = [x + tail for x in encoder.encode_all(batch.column(1))]
            for x in ids:
                counts += np.bincount(np.frombuffer(x, encoder.dtype), minlength=len(counts)) if len(x) > 1 << 16 else 0
            short = [x for x in ids if len(x) <= 1 << 16]
            counts += np.bincount(np.frombuffer(b"".join(short), encoder.dtype), minlength=len(counts))
            yield pa.record_batch([batch.column(0), pa.array([len(x) // encoder.width for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.nulls(len(ids), _COUNTS)], names=["doc_id", "n", "ids", "counts"])
        seen = np.flatnonzero(counts)
        rows = [{"token": int(t), "n": int(counts[t])} for t in seen]
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([rows], _COUNTS)], names=["doc_id", "n", "ids", "counts"])

    return run


def _segment_pass(shared, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = rans.Table.unpack(shared.value), TaskContext.get().partitionId()
        keys: list = []
        blobs: list[bytes] = []
        seq = start = size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(blobs), f"<u{width}").astype(np.int64)
            blob = rans.encode_segment(keys, [len(b) // width for b in blobs], ids, table)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())], names=["part", "seq", "start", "ids", "blob"])

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                blobs.append(ids)
                size += len(ids) // width
                if size >= SEGMENT:
                    yield flush()
                    seq, start, size, keys, blobs = seq + 1, start + size, 0, [], []
        if keys:
            yield flush()

    return run


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END) -> None:
    """Encode docs (doc_id, text) into token files below path."""
    spark = docs.sparkSession
    where = public_tokenizers.path(vocabulary)
    encoder = Encoder(where)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with common.batch_rows(spark, TEXT_ROWS):
        ids, spilled = common.spill(rows.mapInArrow(_encode_pass(where, end), "doc_id long, n long, ids binary, counts array<struct<token:int,n:long>>"), "ids")
    found = ids.filter("counts is not null").select(F.explode("counts").alias("c")).groupBy("c.token").agg(F.sum("c.n").alias("n")).toPandas()
    counts = np.zeros(max(encoder.size, end + 1), np.int64)
    counts[found["token"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    table = rans.Table.from_counts(counts)
    spark.createDataFrame([(bytearray(table.pack()),)], "data binary").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(table.pack())
    parts = max(1, -(-int(counts.sum()) // PART_IDS))
    ordered = ids.filter("counts is null").select("doc_id", "ids").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    segments = ordered.mapInArrow(_segment_pass(shared, encoder.width), "part int, seq int, start long, ids long, blob binary")
    with common.batch_rows(spark, TEXT_ROWS):
        segments.write.option("compression", "none").parquet(f"{path}/segments")
    common.discard(spark, spilled)


def _decode_pass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table.unpack(shared.value)
        for batch in batches:
            for part, start, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                keys, lengths, ids = rans.decode_segment(blob, table)
                data = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.record_batch([pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, from their decoded ids."""
    shared = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/table").first()["data"]))
    segments = spark.read.schema("part int, seq int, start long, ids long, blob binary").parquet(f"{path}/segments")
    rows = segments.select("part", "start", "blob").mapInArrow(_decode_pass(shared), "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = segments.groupBy("part").agg(F.sum("ids").alias("n")).withColumn("block", F.floor(F.col("part") / PARTS_A_BLOCK))  # a row for each file
    earlier = lambda w: F.sum("n").over(w) - F.col("n")
    blocks = sizes.groupBy("block").agg(F.sum("n").alias("n")).select("block", earlier(Window.orderBy("block")).alias("before"))  # a row for PARTS_A_BLOCK files
    bases = sizes.select("block", "part", earlier(Window.partitionBy("block").orderBy("part")).alias("inside")).join(blocks, "block")
    bases = bases.select("part", (F.col("before") + F.col("inside")).alias("base"))
    few = sizes.count() <= BROADCAST_PARTS
    return rows.join(F.broadcast(bases) if few else bases, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    path = common.scratch(docs.sparkSession, "tokens")
    write(docs, path, vocabulary, end)
    return read(docs.sparkSession, path)
