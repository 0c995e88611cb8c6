"""Best-fit packing by sums of squares.

Texts are encoded, each ends with the id ``end``, and a document longer than
``capacity`` is cut into pieces of that size, of which the first may be shorter. Each
piece is placed by the Sum-of-Squares rule: among all open gaps that take it, and a
new sequence, it goes where the sum over gaps g of N(g)**2 becomes smallest, N(g) being
the number of open sequences with g ids of room. Sequences that are full count no more.
Among equal choices the tightest gap wins.

Pieces are written with a row number and dealt to tasks by a hash of it, some ``per_task``
pieces to a task, and each task packs its own sequences, longest pieces first and then by
(doc_id, piece, row), so that a retry gives the same result; no task sees more than its share, and
each leaves only a few sequences unfilled. Texts and ids never move: a piece travels as its length and
checksum. Defined cases: null text is empty and gives one piece, the end id alone;
repeated rows and rows without doc_id are packed each for itself; a text of any length is
encoded whole and then cut; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm import common
from aerolith.llm.tokenize import shared_encoder

CAPACITY = 2048
END = 0
#: Rows of an Arrow batch of texts.
TEXT_ROWS = 1_000
PER_TASK = 50_000
VOCABULARY = "byte_bpe_50k.json"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first is shorter than capacity."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(at, capacity) for at in range(head, n, capacity)]


def _piece_pass(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        tail = np.array([end], "<u4").tobytes()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, found in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1)), strict=True):
                ids = np.frombuffer(found, encoder.dtype).astype("<u4").tobytes() + tail
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, value in zip(out, (doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        column.append(value)
            rows = pa.array(range(row, row + len(out[0])), pa.int64())
            row += len(out[0])
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:]), rows], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return run


class SumOfSquares:
    """Open sequences by gap; place() returns the sequence and the offset there."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # N(g); g = 0 and g = capacity stay 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        n = self.count
        # leaving gap g: (N - 1)^2 - N^2 = 1 - 2N; entering g - size: 2N + 1, or nothing if that fills the sequence
        change = np.where(n[size:] > 0, 2 - 2 * n[size:] + 2 * n[: self.capacity + 1 - size], np.iinfo(np.int64).max)
        if n[size] > 0:
            change[0] = 1 - 2 * n[size]
        change[-1] = 2 * n[self.capacity - size] + 1 if size < self.capacity else 0  # a new sequence
        gap = size + int(change.argmin())
        if gap == self.capacity:
            sequence, self.made = self.made, self.made + 1
        else:
            sequence = self.open[gap].pop()
            n[gap] -= 1
        left = gap - size
        if left:
            self.open[left].append(sequence)
            n[left] += 1
        return sequence, self.capacity - gap


def _pack_pass(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        bins = SumOfSquares(capacity)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(3).to_pylist()]
            yield batch.append_column("sequence_id", pa.array([base + s for s, _ in placed], pa.int64())).append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    return run


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END, per_task: int = PER_TASK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    with common.batch_rows(docs.sparkSession, TEXT_ROWS):
        pieces = common.spill(rows.mapInArrow(_piece_pass(public_tokenizers.path(vocabulary), capacity, end), schema + ", row long"), "pieces")[0]
    tasks = max(1, -(-pieces.count() // per_task))
    dealt = pieces.repartition(tasks, F.xxhash64("row")).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "row").drop("row")
    return dealt.mapInArrow(_pack_pass(capacity), schema + ", sequence_id long, offset long")
