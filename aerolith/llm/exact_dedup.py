"""Exact deduplication by a heavy-hitter split.

Two texts are equal when they are identical after lower-casing A-Z; a null text
counts as empty. The text is identified by the SHA-256 of its lower-cased UTF-8.

1. One pass digests every row and keeps, in each task, a Misra-Gries summary of
   ``counters`` digests (k). Merged, the summaries undercount a digest by at most
   N / (k + 1), so that at most k + 1 digests have a merged count of N / (k + 1)
   or more, and every digest with 2N / (k + 1) rows is among them.
2. Those candidates are counted exactly; the winner of each (its largest doc_id)
   is broadcast, k + 1 rows at most, and their copies are resolved map-side.
3. All other digests, none of which has 2N / (k + 1) rows, are shuffled as usual.

Defined cases: rows with one doc_id are the same document, so that each row that
carries the winning doc_id is marked as kept, and ``keep_winners`` returns one of
them; a null doc_id loses to any other; empty and null texts form one group; a text of any
length is digested whole, one batch of rows in memory at a time; an empty table gives an
empty result. Columns other than doc_id and text are carried by ``keep_winners``, whatever
their names, and never read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm import common
from aerolith.llm.tokenize import forget_encoders

COUNTERS = 256
BROADCAST_ROWS = 500_000
#: Rows of an Arrow batch of texts.
TEXT_ROWS = 1_000


def digest_of(text: bytes | None) -> bytes:
    return hashlib.sha256((text or b"").lower()).digest()


def _digests(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [digest_of(x) for x in pc.cast(column, pa.binary()).to_pylist()]


def merge_summary(summary: Counter, counts: Counter, counters: int) -> int:
    """Misra-Gries: add exact counts, then cut back to ``counters`` entries. Returns what each kept entry lost."""
    summary.update(counts)
    if len(summary) <= counters:
        return 0
    cut = sorted(summary.values(), reverse=True)[counters]
    for key in [k for k, v in summary.items() if v <= cut]:
        del summary[key]
    for key in summary:
        summary[key] -= cut
    return cut


def _digest_pass(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        summary: Counter = Counter()
        for batch in batches:
            digests = _digests(batch.column(1))
            merge_summary(summary, Counter(digests), counters)
            n = len(digests)
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), pa.array(digests, pa.binary()), pa.nulls(n, pa.int64())],
                names=["doc_id", "digest", "weight"],
            )
        if summary:
            yield pa.record_batch(
                [pa.nulls(len(summary), pa.int64()), pa.array(list(summary), pa.binary()), pa.array(list(summary.values()), pa.int64())],
                names=["doc_id", "digest", "weight"],
            )

    return run


def digest_table(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """A written table: a row per document (weight null) and the summaries of all tasks (weight set)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digest_pass(counters), "doc_id long, digest binary, weight long")
    with common.batch_rows(docs.sparkSession, TEXT_ROWS):
        return common.spill(rows, "digests")[0]


def heavy_winners(table: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """digest, keep_id and group_size of the verified heavy digests: counters + 1 rows at most."""
    total = table.filter("weight is null").count()
    candidates = table.filter("weight is not null").groupBy("digest").agg(F.sum("weight").alias("w")).filter(F.col("w") * (counters + 1) >= total)
    rows = table.filter("weight is null").join(F.broadcast(candidates.select("digest")), "digest", "left_semi")
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def mark_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs, written."""
    with common.workspace(docs.sparkSession) as result:
        return result(_marked(digest_table(docs, counters), counters), "marked")


def _marked(table: DataFrame, counters: int) -> DataFrame:
    heavy = F.broadcast(common.spill(heavy_winners(table, counters), "heavy")[0])
    rows = table.filter("weight is null").drop("weight")
    light = rows.join(heavy.select("digest"), "digest", "left_anti")
    groups = light.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return (
        light.join(groups, "digest")
        .unionByName(rows.join(heavy, "digest"))
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    )


def _exceptions(table: DataFrame, heavy: DataFrame) -> DataFrame:
    """digest, id, go of the light documents that go (a larger doc_id has their text), or that several rows repeat (go is false)."""
    light = table.filter("weight is null").join(F.broadcast(heavy.select("digest")), "digest", "left_anti").groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    keep = light.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("rows")).filter("rows > 1").select("digest", "keep_id")
    light = light.join(keep, "digest").withColumn("go", ~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return light.filter("go or n > 1").select("digest", F.col("doc_id").alias("id"), "go")


def keep_winners(docs: DataFrame, counters: int = COUNTERS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs that stay, all columns, one for each distinct text.

    What goes is decided from digests and ids; the rows themselves never leave the JVM. Texts are only shuffled if more than broadcast_rows light documents go or
    repeat; rows that repeat a document, and the winners of heavy digests, are merged to one.
    """
    digest, heavy_digest, keep_id, odd_digest, odd_id, go = (common.unused(docs.columns, c) for c in ("digest_", "heavy_", "keep_", "odd_", "odd_id_", "go_"))
    table = digest_table(docs, counters)
    heavy = common.spill(heavy_winners(table, counters).drop("group_size"), "heavy")[0]
    odd = common.spill(_exceptions(table, heavy), "exceptions")[0]
    few = odd.count() <= broadcast_rows
    odd = odd.toDF(odd_digest, odd_id, go)
    rows = docs.withColumn(digest, F.unhex(F.sha2(common.lower_ascii(F.coalesce("text", F.lit(""))), 256)))
    rows = rows.join(F.broadcast(heavy.toDF(heavy_digest, keep_id)), F.col(digest) == F.col(heavy_digest), "left")
    rows = rows.filter(F.col(heavy_digest).isNull() | F.col("doc_id").cast("long").eqNullSafe(F.col(keep_id)))
    same = (F.col(digest) == F.col(odd_digest)) & F.col("doc_id").cast("long").eqNullSafe(F.col(odd_id))
    rows = rows.join(F.broadcast(odd) if few else odd.hint("shuffle_hash"), same, "left").filter(F.coalesce(~F.col(go), F.lit(True)))
    alone = F.col(heavy_digest).isNull() & F.col(go).isNull()
    merged = rows.filter(~alone).groupBy(digest).agg(F.first(F.struct(*docs.columns)).alias(go)).select(f"{go}.*")
    return rows.filter(alone).select(*docs.columns).unionByName(merged)
