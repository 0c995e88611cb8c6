"""Language-model scores of documents: an online mixing byte model and a unigram base.

Documents whose CRC-32 of doc_id (as text) leaves ``held_out`` modulo ``folds`` are
held out; all others are learned from. The model's score is the log10 probability that
``mixer.Mixer`` gives to the text (A-Z lower-cased) and its end; dividing it by
log10(2) and the text's bytes gives bits per byte. The base is the unigram score of the
text's tokens, its words and one end, with counts from all training documents:
sum of log10((c + 0.5) / (N + 0.5 * (V + 1))).

Corpus statistics cover all training texts and are gathered without collecting texts:

* Words. Each group of documents (``GROUP_BYTES`` of text) keeps its tokens as numbers of
  its own distinct words, and sends the words' hashes and training counts, packed by
  range of the hash. Each range sums the counts and sends them back to the groups.
* Trees. Counts of all runs of four symbols, summed by Spark. Only the rows of the contexts
  that get a tree of their own (``mixer.OWN_TREES``, 257 symbols each at most) and of single
  symbols come to the driver; all other contexts are coded with a shorter one.
* Tables. Each task counts its bits in tables of fixed size and sends the cells that it
  touched, packed by range; the sums become log-odds of one byte a slot. The tables have
  a fixed size (20 MB) whatever the corpus, so that they may be broadcast.

Words are told apart by 64-bit hashes. Defined cases: null text is empty and has the end
only; a null doc_id counts as the text ''; repeated rows each give their row; a text of any
length is scored whole, in pieces that hand on the model's state; an empty table gives no
rows; without training texts the model is the start of the mixer; extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm import common, mixer
from aerolith.llm.language_id import fold

GROUP_BYTES = 8 << 20
RANGE_BYTES = 16 << 20
CELLS = 1 << 16
FOLDS, HELD_OUT = 5, 1
GRAMS = 1 << 18
_TOKEN_TYPE = (
    "g long, part int, doc_ids array<long>, held array<boolean>, text_hash array<long>, lengths array<long>, tokens binary, "
    "hashes binary, places binary, counts binary, grams array<long>, times array<long>"
)
_TOKEN_FIELDS = [("g", pa.int64()), ("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("text_hash", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]
_TOKEN_FIELDS += [("tokens", pa.binary()), ("hashes", pa.binary()), ("places", pa.binary()), ("counts", pa.binary()), ("grams", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]


def text_hash(text: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(text)).astype(np.int64))


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of these texts as numbers, how many each text has, and the distinct words, numbered as they come."""
    lower = pa.array([t.lower() for t in texts], pa.large_binary()).view(pa.large_string())
    split = pc.ascii_split_whitespace(lower)
    edges, words = split.offsets.to_numpy(), split.flatten()
    filled = pc.greater(pc.binary_length(words), 0)  # borders of a text give empty ones
    lengths = np.diff(np.cumsum(np.concatenate([[0], filled.to_numpy(zero_copy_only=False)]))[edges])
    numbers = words.filter(filled).dictionary_encode()
    _, places, joined = numbers.dictionary.buffers()
    places, joined = np.frombuffer(places, np.int64)[: len(numbers.dictionary) + 1].tolist(), joined.to_pybytes() if joined else b""
    return numbers.indices.to_numpy().astype(np.uint32), lengths, [joined[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]


def _token_rows(g: int, docs: list[tuple], parts: int) -> list[dict]:
    flat, lengths, words = _numbered([text for _, _, text in docs])
    trained = flat[np.repeat([not d[1] for d in docs], lengths)]
    counts = np.bincount(trained, minlength=len(words)).astype(np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    part = (hashes % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    rows = [
        {
            "g": g,
            "doc_ids": [d[0] for d in docs],
            "held": [d[1] for d in docs],
            "text_hash": [text_hash(d[2]) for d in docs],
            "lengths": lengths.tolist(),
            "tokens": zstandard.compress(flat.tobytes(), 1),
        }
    ]
    for p in np.flatnonzero(edges[1:] > edges[:-1]):
        at = order[edges[p] : edges[p + 1]]
        rows.append({"g": g, "part": int(p), "hashes": hashes[at].tobytes(), "places": at.astype(np.uint32).tobytes(), "counts": counts[at].astype(np.uint32).tobytes()})
    return rows


def _token_pass(parts: int):
    """For each group its tokens, its words by range, and at the end the task's counts of symbols."""
    schema = pa.schema(_TOKEN_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = TaskContext.get().partitionId() << 32
        docs: list[tuple] = []
        size = 0
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for batch in batches:
            held, texts = batch.column(1).to_pylist(), [t or b"" for t in pc.cast(batch.column(2), pa.binary()).to_pylist()]
            for s, coded, _ in mixer.pieces([t for t, h in zip(texts, held, strict=True) if not h]):
                grams.append(mixer.gram_counts(s, coded))
                waiting += len(grams[-1][0])
                if waiting > 4 * GRAMS and waiting > 2 * len(grams[0][0]):
                    grams = [mixer.added_up(grams)]
                    waiting = len(grams[0][0])
            for row in zip(batch.column(0).to_pylist(), held, texts, strict=True):
                docs.append(row)
                size += len(row[2])
                if size >= GROUP_BYTES:
                    yield pa.RecordBatch.from_pylist(_token_rows(g, docs, parts), schema)
                    g, docs, size = g + 1, [], 0
        if docs:
            yield pa.RecordBatch.from_pylist(_token_rows(g, docs, parts), schema)
        if grams:
            keys, times = mixer.added_up(grams)
            for at in range(0, len(keys), GRAMS):
                yield pa.RecordBatch.from_pylist([{"grams": keys[at : at + GRAMS], "times": times[at : at + GRAMS]}], schema)

    return run


def _sum_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each group's words with their counts in all training texts; and the distinct words and words of this range."""
    groups, places, hashes, counts = [], [], [], []
    for batch in batches:
        groups += batch.column(0).to_pylist()
        places += batch.column(1).to_pylist()
        hashes += [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
        counts += [np.frombuffer(x, np.uint32) for x in batch.column(3).to_pylist()]
    if not groups:
        return
    keys, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts), len(keys)).astype(np.uint64)
    edges = np.cumsum([0] + [len(h) for h in hashes])
    found = [total[inverse[lo:hi]].tobytes() for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    names = ["g", "places", "totals", "distinct", "words"]
    yield pa.record_batch([pa.array(groups, pa.int64()), pa.array(places, pa.binary()), pa.array(found, pa.binary()), pa.nulls(len(groups), pa.int64()), pa.nulls(len(groups), pa.int64())], names=names)
    yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([int((total > 0).sum())]), pa.array([int(total.sum())])], names=names)


def _base_pass(words: int, distinct: int, ends: int):
    """The base scores of a group from its tokens and the counts of its words."""
    whole, scale = words + ends, words + ends + 0.5 * (distinct + (ends > 0) + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        places = [np.frombuffer(x, np.uint32) for x in right.column("places").to_pylist()]
        totals = [np.frombuffer(x, np.uint64) for x in right.column("totals").to_pylist()]
        count = np.zeros(sum(len(p) for p in places), np.float64)
        for p, t in zip(places, totals, strict=True):
            count[p] = t
        logs = np.log10((count + 0.5) / scale)
        end = math.log10((ends + 0.5) / scale)
        for row in left.to_pylist():
            tokens = np.frombuffer(zstandard.decompress(row["tokens"]), np.uint32)
            lengths = np.array(row["lengths"], np.int64)
            at = np.repeat(np.arange(len(lengths)), lengths)
            score = np.bincount(at, logs[tokens], len(lengths)) + end
            known = np.bincount(at, count[tokens] > 0, len(lengths)).astype(np.int64) + (ends > 0)
            parts.append(
                pa.table(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["text_hash"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lengths + 1), pa.array(known), pa.array([whole] * len(lengths), pa.int64()), pa.array(score)],
                    names=["doc_id", "text_hash", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"],
                )
            )
        return pa.concat_tables(parts)

    return run


def _cell_pass(shared):
    """The cells that the training texts of a task touch, packed by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        counts = [np.zeros(2 << bits, np.uint32) for bits in mixer.TABLE_BITS]
        for batch in batches:
            mixer.slot_counts([t or b"" for t in pc.cast(batch.column(0), pa.binary()).to_pylist()], trees, counts)
        part = 0
        for table in counts:
            for at in range(0, len(table), CELLS):
                cells = np.flatnonzero(table[at : at + CELLS])
                if len(cells):
                    n = table[at + cells]
                    kind = np.uint8 if n.max() < 256 else np.uint16 if n.max() < 65536 else np.uint32
                    yield pa.record_batch([pa.array([part], pa.int32()), pa.array([cells.astype(np.uint16).tobytes()], pa.binary()), pa.array([n.astype(kind).tobytes()], pa.binary())], names=["part", "cells", "n"])
                part += 1

    return run


def _odds_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The log-odds of each range from the cells of all tasks."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, cells, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            at = np.frombuffer(cells, np.uint16)
            table = sums.setdefault(part, np.zeros(CELLS, np.uint64))
            table[at] += np.frombuffer(n, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(n) // len(at)])
    for part, table in sums.items():
        odds = mixer.log_odds(table[0::2].astype(np.float64), table[1::2].astype(np.float64))
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([odds.tobytes()], pa.binary())], names=["part", "odds"])


def _score_pass(trees, tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = mixer.Mixer(trees.value, [np.frombuffer(t, np.int8) for t in tables.value])
        for batch in batches:
            texts = [t or b"" for t in pc.cast(batch.column(1), pa.binary()).to_pylist()]
            scores = model.score(texts) / math.log(10)
            yield pa.record_batch([batch.column(0), pa.array([text_hash(t) for t in texts], pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "text_hash", "score"])

    return run


def _trees(table: DataFrame) -> mixer.Trees:
    """The trees, from the counts of runs of four symbols in all training texts."""
    zipped = F.explode(F.arrays_zip("grams", "times")).alias("g")
    grams = common.spill(table.filter("grams is not null").select(zipped).groupBy(F.col("g.grams").alias("k")).agg(F.sum("g.times").alias("n")), "grams")[0]

    def rows(length: int, most: int | None) -> tuple[np.ndarray, np.ndarray]:
        counts = grams.groupBy((F.col("k") % mixer.SYMBOLS ** (length + 1)).alias("k")).agg(F.sum("n").alias("n"))
        if most is not None:
            context = F.floor(F.col("k") / mixer.SYMBOLS).alias("c")
            own = counts.groupBy(context).agg(F.sum("n").alias("all")).filter(F.col("all") >= mixer.MIN_TREE).orderBy(F.desc("all"), "c").limit(most)
            counts = counts.withColumn("c", context).join(F.broadcast(own), "c")  # most rows at most
        found = counts.select("k", "n").toArrow()
        return found.column("k").to_numpy(), found.column("n").to_numpy()

    return mixer.Trees(rows(1, None), *(rows(length, most) for length, most in zip((2, 3), mixer.OWN_TREES, strict=True)))


def _tables(docs: DataFrame, trees) -> list[bytes]:
    """The log-odds of all slots, from all training texts."""
    cells = docs.select("text").mapInArrow(_cell_pass(trees), "part int, cells binary, n binary")
    ranges = [(2 << bits) // CELLS for bits in mixer.TABLE_BITS]
    dealt = cells.repartitionById(min(sum(ranges), common.shuffle_partitions(docs.sparkSession)), F.pmod(F.col("part"), F.lit(min(sum(ranges), common.shuffle_partitions(docs.sparkSession)))))
    found = {r["part"]: bytes(r["odds"]) for r in dealt.mapInArrow(_odds_pass, "part int, odds binary").collect()}
    blank = np.full(CELLS // 2, mixer.UNSEEN, np.int8).tobytes()
    first = np.cumsum([0, *ranges])
    return [b"".join(found.get(p, blank) for p in range(lo, hi)) for lo, hi in zip(first[:-1], first[1:], strict=True)]


def score(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs, written."""
    with common.workspace(docs.sparkSession) as result:
        return result(_score(docs, folds, held_out), "lm")


def _score(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), folds) == held_out).alias("held"), "text")
    size, ends = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held"))).first()
    parts = max(common.shuffle_partitions(spark), -(-int(size) // RANGE_BYTES))

    table, table_path = common.spill(rows.mapInArrow(_token_pass(parts), _TOKEN_TYPE), "tokens")
    dealt = table.filter("part is not null").select("g", "places", "hashes", "counts", "part").repartitionById(parts, F.col("part")).drop("part")
    sums, sums_path = common.spill(dealt.mapInArrow(_sum_pass, "g long, places binary, totals binary, distinct long, words long"), "sums")
    distinct, words = sums.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    own = table.filter("tokens is not null").select("g", "doc_ids", "held", "text_hash", "lengths", "tokens")
    answers = sums.filter("g is not null").select("g", "places", "totals")
    schema = "doc_id long, text_hash long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double"
    base = common.spill(own.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_base_pass(int(words), int(distinct), int(ends)), schema), "base")[0]

    trees = spark.sparkContext.broadcast(_trees(table))
    common.discard(spark, table_path, sums_path)
    tables = spark.sparkContext.broadcast(_tables(rows.filter("not held"), trees))
    scored = rows.select("doc_id", "text").mapInArrow(_score_pass(trees, tables), "doc_id long, text_hash long, score double")
    scored = common.spill(scored, "scores")[0].groupBy("doc_id", "text_hash").agg(F.min("score").alias("score"))
    scored = scored.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    joined = base.join(scored, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))
    return joined.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
