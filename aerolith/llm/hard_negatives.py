"""Hard negatives by coordinate pruning in length buckets.

Rows are vectors with a label; a row's score is its integer inner product with an
anchor (components become floor(scale * x)). An anchor's positives are its first
``positives`` other rows of the same label; the negatives of a positive are the first
``negatives`` rows of another label whose score lies between ``low`` percent of the positive's
and the positive's. Higher scores come first, ties by smaller vec_id.

1. Rows are ranged by length and written in blocks of ``BLOCK`` at most: a block is a
   length bucket with a sorted list of each coordinate. Anchors are
   dealt by hash to blocks of about ``ANCHORS``, in which each anchor names its few
   largest coordinates as focus coordinates.
2. Each pair of blocks is a cell, a row of an equi-join. In a cell a threshold t on the
   score gives each focus coordinate f of an anchor a range in which a row's unit vector must lie,
   a_f c - s .. a_f c + s, where c = t / (|a| L), L is the bucket's largest length and
   s = sqrt((1 - a_f^2)(1 - c^2)); rows beyond |a| L < t go as a whole. Binary search in
   the sorted lists gives each range; where the narrowest leaves less than
   half of the bucket, its rows are checked against the other ranges, and only those in all of
   them are scored; otherwise the whole bucket is.
3. Positives are found first: the threshold of an anchor is its best ``positives`` + 1 scores in the cell's
   earlier buckets. Negatives take theirs from the positives. A cell returns
   so many rows for each anchor or positive at most, and the first of all cells are taken.

Scores are exact: float64 products below 2^53, whole numbers of any size beyond.

Defined cases: rows with a null label or vec_id, a null vector or any component that is null or
not finite take no part; a row whose vec_id is divisible by ``shifted`` has its label
moved by one of ten; a shorter vector counts as if it had zeros at its end; an empty vector scores 0;
a positive with a negative score has no negatives, as its interval is empty; rows that repeat a vec_id are
rows of their own, so that a copy of the anchor can be its positive and a repeated anchor
gives its results once for each of its rows; scores beyond 2^62 count as 2^62; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm import common

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LOW = 80
ANCHOR_EVERY = 100
SHIFTED = 7
BLOCK = 4096
BUCKET = 512
ANCHORS = 4096
FOCUS = 4
LIMIT = 1 << 62
#: What the bounds of ranges give away to rounding.
SLACK = 1e-9


def prepared(rows: DataFrame, scale: int = SCALE, shifted: int = SHIFTED) -> DataFrame:
    """vec_id, label, v (whole numbers as doubles), size (their length) of the rows that take part."""
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    kept = kept.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull())
    kept = kept.filter(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    label = F.when(F.col("vec_id") % shifted == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = F.transform("e", lambda x: _floor(F.lit(float(scale)) * x))
    kept = kept.select("vec_id", label.alias("label"), v.alias("v"))
    return kept.withColumn("size", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))


def _floor(x: Column) -> Column:
    """floor as a double; doubles from 2^52 on are whole, and 1e300 is taken for more."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(F.least(F.greatest(x, F.lit(-1e300)), F.lit(1e300)))


def _matrix(vectors: list[list[float]], width: int | None = None) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0) if width is None else width
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _bytes(v: np.ndarray) -> bytes:
    """Whole numbers below 2^24 fit into 4 bytes."""
    return (v.astype(np.float32) if np.abs(v).max(initial=0) < float(1 << 24) else v).tobytes()


def _vectors(data: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if len(data) == 4 * n * width else np.float64).astype(np.float64).reshape(n, width)


def _column(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(name).to_numpy()


def _pack_rows(size: int):
    """The rows of a task, longest first, as blocks: block (the task), ids, labels, width, vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                rows = batch.slice(at, size)
                v = _matrix(rows.column("v").to_pylist())
                yield pa.record_batch(
                    [pa.array([task]), *(pa.array([_column(rows, c).astype(np.int64).tobytes()], pa.binary()) for c in ("vec_id", "label")), pa.array([v.shape[1]]), pa.array([_bytes(v)], pa.binary())],
                    names=["block", "ids", "labels", "width", "vectors"],
                )

    return run


def _pack_anchors(table: pa.Table) -> pa.Table:
    v = _matrix(table.column("v").to_pylist())
    ids, labels, copies = (_column(table, c).astype(np.int64) for c in ("vec_id", "label", "copies"))
    columns = [pa.array([table.column("deal")[0].as_py()], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, copies))]
    return pa.table([*columns, pa.array([v.shape[1]], pa.int64()), pa.array([_bytes(v)], pa.binary())], names=["deal", "a_ids", "a_labels", "a_copies", "a_width", "a_vectors"])


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole inner products of rows of a with rows of b, cut at 2^62."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * width < float(1 << 53):
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in b.tolist()]
    out = np.empty((len(a), len(b)), np.int64)
    for i, row in enumerate(a.tolist()):
        row = [int(x) for x in row]
        out[i] = [max(-LIMIT, min(LIMIT, sum(map(int.__mul__, row, other)))) for other in whole]
    return out


class Bucket:
    """Rows of about one length: their unit vectors, and a sorted list of each coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        sizes = np.sqrt((vectors**2).sum(1))
        self.longest = float(sizes.max())
        self.unit = vectors / np.maximum(sizes, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def candidates(self, unit: np.ndarray, focus: np.ndarray, size: float, least: float) -> np.ndarray | None:
        """Rows that can reach the score least with an anchor; None for all of them. No row that reaches it is left out."""
        if least <= 0 or size <= 0:
            return None
        cosine = least / (size * self.longest) if self.longest > 0 else np.inf
        if cosine > 1 + SLACK:
            return np.zeros(0, np.int64)
        cosine = min(1.0, cosine)
        f = focus[focus < self.unit.shape[1]]
        if not len(f):
            return None
        spread = np.sqrt(np.maximum(0, 1 - unit[f] ** 2) * (1 - cosine**2))
        low, high = unit[f] * cosine - spread, unit[f] * cosine + spread
        # angles that pass the axis itself
        low, high = np.where(unit[f] < -cosine, -1.0, low) - SLACK, np.where(unit[f] > cosine, 1.0, high) + SLACK
        ranges = []
        for k, (lo, hi) in enumerate(zip(low, high, strict=True)):
            values = self.sorted_list(int(f[k]))[1]
            ranges.append((int(np.searchsorted(values, lo)), int(np.searchsorted(values, hi, "right"))))
        best = min(range(len(f)), key=lambda k: ranges[k][1] - ranges[k][0])
        a, b = ranges[best]
        if 2 * (b - a) > len(self.ids):
            return None
        rows = self.sorted_list(int(f[best]))[0][a:b]
        for k in range(len(f)):
            if k != best and len(rows):
                x = self.unit[rows, f[k]]
                rows = rows[(x >= low[k]) & (x <= high[k])]
        return rows


class Cell:
    """A block of anchors and a block of rows."""

    def __init__(self, row: dict):
        self.a_ids, self.a_labels, self.copies = (np.frombuffer(row[c], np.int64) for c in ("a_ids", "a_labels", "a_copies"))
        self.a = _vectors(row["a_vectors"], len(self.a_ids), row["a_width"])
        ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        v = _vectors(row["vectors"], len(ids), row["width"])
        self.buckets = [Bucket(ids[k : k + BUCKET], labels[k : k + BUCKET], v[k : k + BUCKET]) for k in range(0, len(ids), BUCKET)]
        self.sizes = np.sqrt((self.a**2).sum(1))
        self.unit = self.a / np.maximum(self.sizes, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(self.a), axis=1, kind="stable")[:, :FOCUS]

    def scores(self, bucket: Bucket, least: np.ndarray, asked: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """anchor, rows of the bucket and their scores, for the anchors asked; all rows that reach least are among them."""
        whole = []
        for i in asked.tolist():
            rows = bucket.candidates(self.unit[i], self.focus[i], float(self.sizes[i]), float(least[i]))
            if rows is None:
                whole.append(i)
            elif len(rows):
                yield i, rows, inner_products(self.a[i : i + 1], bucket.vectors[rows])[0]
        every = np.arange(len(bucket.ids))
        if whole:
            for i, scores in zip(whole, inner_products(self.a[whole], bucket.vectors), strict=True):
                yield i, every, scores

    def own(self, i: int, bucket: Bucket, rows: np.ndarray) -> np.ndarray:
        """Which rows are copies of anchor i: its vec_id, label and vector."""
        same = (bucket.ids[rows] == self.a_ids[i]) & (bucket.labels[rows] == self.a_labels[i])
        for k in np.flatnonzero(same):
            same[k] = np.array_equal(_trimmed(bucket.vectors[rows[k]]), _trimmed(self.a[i]))
        return same


def _trimmed(v: np.ndarray) -> np.ndarray:
    return np.trim_zeros(v, "b")


def _first(ids: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the first count, higher scores first, ties by smaller id."""
    if len(scores) > 4 * count:
        cut = np.partition(scores, len(scores) - count)[len(scores) - count]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))[:count]]
    return np.lexsort((ids, -scores))[:count]


def _positive_pass(count: int):
    """deal, slot (of the anchor), vec_id, score, own: the first count rows of a cell for each of its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cell = Cell(row)
                n = len(cell.a_ids)
                found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * n
                least = np.full(n, -np.inf)
                for bucket in cell.buckets:
                    for i, rows, scores in cell.scores(bucket, least, np.arange(n)):
                        good = (bucket.labels[rows] == cell.a_labels[i]) & (scores >= least[i])
                        rows, scores = rows[good], scores[good]
                        if not len(rows):
                            continue
                        first = _first(bucket.ids[rows], scores, count)
                        rows, scores = rows[first], scores[first]
                        ids, scores, own = (np.concatenate(x) for x in zip(found[i], (bucket.ids[rows], scores, cell.own(i, bucket, rows)), strict=True))
                        first = _first(ids, scores, count)
                        found[i] = ids[first], scores[first], own[first]
                        if len(first) == count:
                            least[i] = scores[first[-1]]
                slot = np.repeat(np.arange(n), [len(x[0]) for x in found])
                ids, scores, own = (np.concatenate([x[k] for x in found]) for k in range(3))
                yield pa.record_batch([pa.array(np.full(len(ids), row["deal"], np.int64)), pa.array(slot.astype(np.int32)), pa.array(ids), pa.array(scores), pa.array(own)], names=["deal", "slot", "vec_id", "score", "own"])

    return run


def _negative_pass(count: int, low: int):
    """The first count rows of a cell for each positive of its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cell = Cell(row)
                targets: dict[int, list[tuple[int, int, int, int]]] = {}
                for p in row["targets"]:
                    if p["score"] >= 0:
                        targets.setdefault(p["slot"], []).append((p["place"], p["vec_id"], p["score"], -(-low * p["score"] // 100)))
                asked = np.array(sorted(targets), np.int64)
                least = np.full(len(cell.a_ids), np.inf)
                for i, wanted in targets.items():
                    least[i] = min(w[3] for w in wanted)
                found: dict[tuple[int, int, int, int], tuple[np.ndarray, np.ndarray]] = {}
                for bucket in cell.buckets:
                    for i, rows, scores in cell.scores(bucket, least, asked):
                        good = (bucket.labels[rows] != cell.a_labels[i]) & (scores >= least[i])
                        ids, scores = bucket.ids[rows[good]], scores[good]
                        for place, vec_id, most, fewest in targets[i]:
                            inside = (scores <= most) & (scores >= fewest)
                            if inside.any():
                                key = (i, place, vec_id, most)
                                old = found.get(key, (ids[:0], scores[:0]))
                                all_ids, all_scores = np.concatenate([old[0], ids[inside]]), np.concatenate([old[1], scores[inside]])
                                first = _first(all_ids, all_scores, count)
                                found[key] = all_ids[first], all_scores[first]
                lengths = [len(x[0]) for x in found.values()]
                keys = np.repeat(np.array(list(found), np.int64).reshape(-1, 4), lengths, axis=0)
                slot = keys[:, 0]
                ids, scores = (np.concatenate([x[k] for x in found.values()]) if found else np.zeros(0, np.int64) for k in range(2))
                yield pa.record_batch(
                    [pa.array(np.full(len(ids), row["deal"], np.int64)), *(pa.array(x) for x in (slot, cell.a_ids[slot], cell.copies[slot], keys[:, 1], keys[:, 2], keys[:, 3], ids, scores))],
                    names=["deal", "slot", "anchor_id", "copies", "place", "positive_id", "positive_score", "negative_id", "negative_score"],
                )

    return run


def _cells(anchors: DataFrame, rows: DataFrame, deals: int, tasks: int) -> DataFrame:
    """A row for each pair of a block of anchors and a block of rows, dealt over the tasks by both."""
    rows = rows.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))).withColumn("deal", F.col("deal").cast("long"))
    anchors = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).withColumn("block", F.col("block").cast("long"))
    return rows.hint("shuffle_hash").join(anchors, ["deal", "block"])


def mine(
    rows: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    anchor_every: int = ANCHOR_EVERY,
    scale: int = SCALE,
    shifted: int = SHIFTED,
    block: int = BLOCK,
    anchor_block: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, written."""
    spark = rows.sparkSession
    with common.workspace(spark) as result, common.batch_rows(spark, block):
        table = prepared(rows, scale, shifted)
        total = table.count()
        tasks = total // block + 1
        ranged = table.repartitionByRange(tasks, F.desc("size"), F.xxhash64("vec_id")).sortWithinPartitions(F.desc("size"))
        blocks = common.spill(ranged.mapInArrow(_pack_rows(block), "block long, ids binary, labels binary, width long, vectors binary"), "blocks")[0]
        wanted = table.filter(F.col("vec_id") % anchor_every == 0).groupBy("vec_id", "label", "v").agg(F.count(F.lit(1)).alias("copies"))
        deals = total // (anchor_every * anchor_block) + 1
        dealt = wanted.withColumn("deal", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(deals)))
        schema = "deal long, a_ids binary, a_labels binary, a_copies binary, a_width long, a_vectors binary"
        anchors = common.spill(dealt.select("deal", "vec_id", "label", "copies", "v").groupBy("deal").applyInArrow(_pack_anchors, schema), "anchors")[0]
        with common.batch_rows(spark, 4):  # cells are large
            cells = _cells(anchors, blocks, deals, tasks)
            near = cells.mapInArrow(_positive_pass(positives + 1), "deal long, slot int, vec_id long, score long, own boolean")
            by_anchor = Window.partitionBy("deal", "slot")
            order = [F.desc("score"), F.asc("vec_id"), F.desc("own")]
            near = near.withColumn("place", F.row_number().over(by_anchor.orderBy(*order))).filter(F.col("place") <= positives + 1)
            near = near.withColumn("mine", F.row_number().over(by_anchor.orderBy(F.desc("own"), "place"))).filter(~(F.col("own") & (F.col("mine") == 1)))
            near = near.withColumn("place", F.row_number().over(by_anchor.orderBy("place"))).filter(F.col("place") <= positives)
            targets = common.spill(near.groupBy("deal").agg(F.collect_list(F.struct("slot", "place", "vec_id", "score")).alias("targets")), "targets")[0]
            cells = _cells(anchors.join(targets, "deal"), blocks, deals, tasks)
            columns = "deal long, slot long, anchor_id long, copies long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
            found = cells.mapInArrow(_negative_pass(negatives, low), columns)
            by_positive = Window.partitionBy("deal", "slot", "place").orderBy(F.desc("negative_score"), F.asc("negative_id"))
            found = found.withColumn("rank", F.row_number().over(by_positive)).filter(F.col("rank") <= negatives)
            found = found.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
            return result(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "hard_negatives")
