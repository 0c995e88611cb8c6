"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order context tree over the bytes of its training
texts, A-Z lower-cased: the counts of each byte after each context of up to ``ORDER``
bytes. A text is coded under each language with the statistics frozen. A byte's
probability comes from the longest context that the language knows; if the byte
wasn't seen there, the escape probability (method C: distinct / (total + distinct))
is paid, bytes seen there are excluded, and the next shorter context is asked, down
to a uniform order -1. The text goes to the language with the shortest code; the
score is that language's posterior probability under equal priors.

As statistics are frozen, the code length of a byte depends on it and the ORDER bytes
before it only. All of them are worked out once, into a table of costs for (context,
byte, language) that is broadcast, a block of languages at a time; a text is then a sum of look-ups.

Bounds: the trees are fitted on about ``train_rows`` rows of each language, chosen by
a hash of doc_id, with all of their (ORDER + 1)-grams; every row is scored on its whole
text. Every lang value is learned. Languages are dealt in order to blocks with cost tables
of about ``BLOCK_CELLS`` cells; a text's shortest code and the sum over languages are carried
from block to block, so that only one block is in memory. Defined cases: null text, text without a
letter, or a table without any labelled row give ``und`` with score 0; ties go to the
language that sorts first; a null doc_id counts as the text ''; repeated rows each give
their row, and each counts in the training fold; a text of any length is scored in pieces of
``CHUNK_BYTES`` that keep their context; an empty table gives no rows; extra columns are
carried by ``keep_identified``, whatever their names, and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm import common
from aerolith.llm.tokenize import forget_encoders

UNDETERMINED = "und"
ORDER = 3
TRAIN_ROWS = 2_000
BLOCK_CELLS = 1 << 26
CHUNK_BYTES = 1 << 18
#: Rows of an Arrow batch of texts.
TEXT_ROWS = 1_000
_PAD = b"\n" * ORDER


def fold(doc_id: Column, folds: int) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds).cast("int")


def _gram_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n for the texts of a task; a gram is ORDER + 1 bytes, big-endian."""
    forget_encoders()
    waiting: dict[str, list[bytes]] = {}
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def settle(lang: str) -> None:
        data = np.frombuffer(b"".join(waiting.pop(lang)), np.uint8).astype(np.uint32)
        grams = np.zeros(len(data) - ORDER, np.uint32)
        for k in range(ORDER + 1):
            grams = (grams << 8) | data[k : len(data) - ORDER + k]
        keys, n = np.unique(grams, return_counts=True)
        if lang in counts:
            keys, at = np.unique(np.concatenate([counts[lang][0], keys]), return_inverse=True)
            n = np.bincount(at, np.concatenate([counts[lang][1], n])).astype(np.int64)
        counts[lang] = (keys, n)

    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary()).to_pylist(), strict=True):
            waiting.setdefault(lang, []).append(_PAD + (text or b"").lower())
            size[lang] = size.get(lang, 0) + len(text or b"")
            if size[lang] > CHUNK_BYTES:
                settle(lang)
                size[lang] = 0
    for lang in list(waiting):
        settle(lang)
    for lang, (keys, n) in counts.items():
        yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


class Model:
    """Costs in bits of each byte after each context, for all languages."""

    def __init__(self, languages: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        used = np.zeros(256, bool)
        for keys, _ in grams.values():
            for k in range(ORDER + 1):
                used[(keys >> (8 * k)) & 255] = True
        self.symbol = np.full(256, int(used.sum()), np.int64)
        self.symbol[used] = np.arange(int(used.sum()))
        a = self.alphabet = int(used.sum()) + 1  # the last stands for all bytes never seen
        unseen = 256 - a + 1
        rows = [np.zeros(1, np.int64)]  # contexts of each order, as numbers in base a
        coded = {}
        for lang, (keys, n) in grams.items():
            code = np.zeros(len(keys), np.int64)
            for k in range(ORDER, -1, -1):
                code = code * a + self.symbol[(keys >> (8 * k)) & 255]
            coded[lang] = (code, n.astype(np.float64))
        for order in range(1, ORDER + 1):
            found = [(code // a) % a**order for code, _ in coded.values()]
            rows.append(np.unique(np.concatenate(found)))
        first = np.cumsum([0] + [len(r) for r in rows])
        self.costs = np.zeros((first[-1], a, len(languages)), np.float32)
        for at, lang in enumerate(languages):
            code, n = coded[lang]
            tables = []
            for order, keys in enumerate(rows):
                ctx = np.searchsorted(keys, (code // a) % a**order)
                tables.append(np.bincount(ctx * a + code % a, n, len(keys) * a).reshape(len(keys), a))
            for order, keys in enumerate(rows):
                self.costs[first[order] : first[order + 1], :, at] = self._code_lengths(order, keys, rows, tables, a, unseen)
        self.context = np.zeros(a**ORDER, np.int32)
        grid = self.context.reshape((a,) * ORDER)
        for order in range(1, ORDER + 1):
            ids = np.arange(first[order], first[order + 1])
            digits = [(rows[order] // a ** (order - 1 - k)) % a for k in range(order)]
            grid[(..., *digits)] = ids

    @staticmethod
    def _code_lengths(order: int, keys: np.ndarray, rows: list, tables: list, a: int, unseen: int) -> np.ndarray:
        cost = np.zeros((len(keys), a))
        left = np.ones((len(keys), a), bool)  # bytes not coded nor excluded yet
        escaped = np.zeros(len(keys))
        for k in range(order, -1, -1):
            at = np.searchsorted(rows[k], keys % a**k)
            n = np.where(left, tables[k][at], 0)
            total, distinct = n.sum(1), (n > 0).sum(1)
            known = total > 0
            hit = n > 0
            with np.errstate(divide="ignore"):
                bits = escaped[:, None] - np.log2(n / np.maximum(total + distinct, 1)[:, None])
            cost[hit] = bits[hit]
            escaped = escaped + np.where(known, np.log2(np.maximum(total + distinct, 1)) - np.log2(np.maximum(distinct, 1)), 0)
            left &= ~hit
        size = left.sum(1) - 1 + unseen  # the last symbol stands for `unseen` bytes
        cost = np.where(left, (escaped + np.log2(np.maximum(size, 1)))[:, None], cost)
        return cost

    def bits(self, pieces: list[tuple[bytes, bytes]]) -> np.ndarray:
        """Code length under each language of the second part of each pair, which follows the ORDER bytes of the first."""
        data = np.frombuffer(b"".join(x for piece in pieces for x in piece), np.uint8)
        s = self.symbol[data]
        a = self.alphabet
        ctx = np.zeros(len(s) - ORDER, np.int64)
        for k in range(ORDER):
            ctx = ctx * a + s[k : len(s) - ORDER + k]
        costs = self.costs.reshape(-1, len(self.languages))[self.context[ctx].astype(np.int64) * a + s[ORDER:]].astype(np.float64)
        lengths = np.array([len(text) for _, text in pieces])
        starts = np.cumsum(lengths + ORDER) - lengths - ORDER  # of each text in costs, as its context comes before it
        sums = np.concatenate([np.zeros((1, costs.shape[1])), np.cumsum(costs, axis=0)])
        return sums[starts + lengths] - sums[starts]


def _blocks(sizes: list[tuple[str, int]], block_cells: int) -> Iterator[list[str]]:
    """Languages in ascending order, as many in a block as keep its table (contexts x bytes x languages) within block_cells; one at least."""
    block, grams = [], 0
    for lang, n in sorted(sizes):
        if block and (grams + n) * 256 * (len(block) + 1) > block_cells:
            yield block
            block, grams = [], 0
        block.append(lang)
        grams += n
    if block:
        yield block


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, block_cells: int = BLOCK_CELLS) -> Iterator[Model]:
    """A model for each block of languages, fitted on docs (lang, text): about train_rows rows of each language, chosen by a hash of doc_id."""
    labelled = docs.filter("lang is not null and text is not null")
    counts = [(r["lang"], min(1.0, train_rows / r["count"])) for r in labelled.groupBy("lang").count().collect()]
    if not counts:
        return
    share = F.broadcast(docs.sparkSession.createDataFrame(counts, "lang string, share double"))  # a row for each language
    draw = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30))).cast("double")
    chosen = labelled.join(share, "lang").filter(draw < F.col("share")).select("lang", "text")
    grams = chosen.mapInArrow(_gram_pass, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = common.spill(grams, "grams")[0]
    # distinct contexts bound the rows of a language's table
    contexts = grams.select("lang", F.shiftright("gram", 8).alias("c")).distinct().groupBy("lang").count()
    for block in _blocks([tuple(r) for r in contexts.collect()], block_cells):
        rows = grams.filter(F.col("lang").isin(block)).toPandas()
        yield Model(block, {lang: (part["gram"].to_numpy(), part["n"].to_numpy()) for lang, part in rows.groupby("lang")})


def _pieces(texts: list[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Batches of (row, context, text) of CHUNK_BYTES or so; a longer text is cut, and its pieces keep their context."""
    out, size = [], 0
    for row, text in texts:
        padded = _PAD + text
        for at in range(0, len(text), CHUNK_BYTES):
            piece = padded[at + ORDER : at + ORDER + CHUNK_BYTES]
            out.append((row, padded[at : at + ORDER], piece))
            size += len(piece)
            if size >= CHUNK_BYTES:
                yield out
                out, size = [], 0
    if out:
        yield out


def classify(texts: list[bytes | None], letters: list[bool | None], model: Model) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Of each text the language with the shortest code, that code's length in bits, and the sum over languages of their likelihoods relative to its."""
    langs: list[str | None] = [None] * len(texts)
    todo = [(i, t.lower()) for i, (t, ok) in enumerate(zip(texts, letters, strict=True)) if t is not None and ok]
    bits = np.zeros((len(texts), len(model.languages)))
    for part in _pieces(todo):
        np.add.at(bits, [row for row, _, _ in part], model.bits([piece for _, *piece in part]))
    best = bits.argmin(1)
    least = bits.min(1)
    mass = np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
    for i, _ in todo:
        langs[i] = model.languages[best[i]]
    return langs, least, mass


def _block_pass(shared, first: bool, state: list[str]):
    """Batches with the state after one more block of languages; on a tie the earlier language stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            text = pc.cast(batch.column(batch.schema.get_field_index("text")), pa.string())
            langs, bits, mass = classify(pc.cast(text, pa.binary()).to_pylist(), pc.match_substring_regex(text, r"\p{L}").to_pylist(), shared.value)
            columns = [batch.column(i) for i in range(batch.num_columns)]
            if not first:
                old_langs, old_bits, old_mass = (c.to_pylist() for c in columns[-3:])
                old_bits, old_mass = np.array(old_bits), np.array(old_mass)
                langs = [new if n < o else old for new, old, n, o in zip(langs, old_langs, bits, old_bits, strict=True)]
                least = np.minimum(bits, old_bits)
                mass = mass * np.exp2(np.maximum(least - bits, -1000)) + old_mass * np.exp2(np.maximum(least - old_bits, -1000))
                bits, columns = least, columns[:-3]
            names = [*batch.schema.names[: len(columns)], *state]
            yield pa.record_batch([*columns, pa.array(langs, pa.string()), pa.array(bits, pa.float64()), pa.array(mass, pa.float64())], names=names)

    return run


def predict(docs: DataFrame, models: Iterator[Model]) -> tuple[DataFrame, str, str]:
    """docs with the language and its score, and the names of these two columns; only text is read for them. With several blocks the rows are written between them."""
    spark, fields, rows, path = docs.sparkSession, docs.schema, docs, None
    lang, bits, mass, out = state = [common.unused(docs.columns, c) for c in ("lang_pred", "lang_bits", "lang_mass", "lang_score")]
    shared = None
    for model in models:
        if shared is not None:
            rows, done = common.spill(rows, "languages")
            shared.destroy()
            if path:
                common.discard(spark, path)
            path = done
        first, shared = shared is None, spark.sparkContext.broadcast(model)
        rows = rows.mapInArrow(_block_pass(shared, first, state[:3]), common.extended(fields, **{lang: "string", bits: "double", mass: "double"}))
    if shared is None:
        return docs.select("*", F.lit(UNDETERMINED).alias(lang), F.lit(0.0).alias(out)), lang, out
    score = F.when(F.col(lang).isNull(), F.lit(0.0)).otherwise(1 / F.col(mass))
    return rows.select(*docs.columns, F.coalesce(lang, F.lit(UNDETERMINED)).alias(lang), score.alias(out)), lang, out


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, **limits: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, written; rows of the held-out fold are never learned from."""
    out = fold(F.col("doc_id"), folds) == held_out
    with common.batch_rows(docs.sparkSession, TEXT_ROWS), common.workspace(docs.sparkSession) as result:
        models = train(docs.filter(~out).select("doc_id", "text", "lang"), **limits)
        rows, lang, score = predict(docs.select("doc_id", "text"), models)
        return result(rows.select("doc_id", out.alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score")), "languages")


def keep_identified(docs: DataFrame, languages: list[str] | None = None, min_score: float = 0.5, folds: int = 4, held_out: int = 2) -> DataFrame:
    """The rows of docs, written, whose language was found with min_score at least, one of ``languages`` if these are given."""
    out = fold(F.col("doc_id"), folds) == held_out
    with common.batch_rows(docs.sparkSession, TEXT_ROWS), common.workspace(docs.sparkSession) as result:
        models = train(docs.filter(~out).select("doc_id", "text", "lang"))
        rows, lang, score = predict(docs, models)
        rows = rows.filter((F.col(lang) != UNDETERMINED) & (F.col(score) >= min_score))
        return result((rows.filter(F.col(lang).isin(languages)) if languages else rows).select(*docs.columns), "identified")
