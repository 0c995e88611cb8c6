"""Phrase collocations by mergeable Misra-Gries summaries and an exact second count.

Texts are lower-cased (A-Z alone), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those
into words ``[^\\x20\\x09]+``. Everything is counted per language. A candidate is a
phrase of 2 to ``LONGEST`` words that stands ``threshold`` times or more, overlaps
included; its score is the lowest of floor(1000 a n / (l r)) over its cuts into a
first part (l times) and a rest (r times).

1. Words are counted exactly. Those with ``threshold`` places or more make a bitmap.
2. Pairs of such words, then runs of 3 to ``LONGEST`` words all of whose pairs survived
   (no other phrase can reach the threshold), are summarised: each block of
   tokens gives one summary per hash partition with a counter for each of its n-grams,
   and the summaries of a partition are merged by Misra-Gries. The merged summary has
   mass // threshold + 1 counters, so that whatever it takes from an n-gram stays below
   the threshold and every frequent n-gram survives. There are as many partitions as
   keep the mass of one below ``PART_MASS``; a block sends an n-gram at most once, so
   that no n-gram makes a partition large.
3. The survivors are counted exactly, by their words, not by hashes.

What is broadcast are bitmaps of 2 ** MAX_BITS bits (16 MB) at most. Where survivors
are too many for one, it passes more n-grams; they cost time, never results.

Defined cases: a null or empty text has no words; a null language is ``und``, together with
rows that say so; repeated rows count each; a text of any length is read whole, in blocks that
overlap by ``LONGEST`` - 1 words; ties of the score go to the cut with the smallest
first part, ties of the rank to the more frequent and then the first phrase in byte
order; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.llm import common

THRESHOLD = 100
LONGEST = 5
TOP = 2000
#: Words in a block, and bytes of a text that are split at once.
BLOCK = 1 << 20
BITE = 1 << 22
#: N-grams of one hash partition.
PART_MASS = 1 << 22
MAX_BITS = 27
VOCABULARY = 1_000_000

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_CLEAN = bytes.maketrans(common.UPPER.encode() + _SEPARATORS, common.UPPER.lower().encode() + b"." * len(_SEPARATORS))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Vocabulary(dict):
    """Word -> number; number 0 is the border of pieces."""

    def __init__(self) -> None:
        super().__init__({b".": 0})
        self.words, self._hashes = [b"."], [0]

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.words)
        self.words.append(word)
        self._hashes.append(xxhash.xxh64_intdigest(word))
        return at

    def hashes(self) -> np.ndarray:
        return np.array(self._hashes, np.uint64)


def bites(text: bytes, size: int = BITE) -> Iterator[list[bytes]]:
    """The words of a text and "." for each border, split a bite at a time; no word is cut."""
    text = text.translate(_CLEAN)
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            found = [x for x in (text.find(b"%c" % c, end) for c in b". \t") if x >= 0]
            end = min(found) if found else len(text)
        yield text[at:end].replace(b".", b" . ").split()
        at = end


class Block:
    """Tokens of many texts: numbers of words, a language for each, and whether they count here or are the end of the bite before."""

    def __init__(self, ids: np.ndarray, langs: np.ndarray, fresh: np.ndarray, names: list[str], vocabulary: Vocabulary):
        self.ids, self.langs, self.fresh, self.names, self.vocabulary = ids, langs, fresh, names, vocabulary
        self._lang_hash = np.array([xxhash.xxh64_intdigest(n.encode(), 1) for n in names], np.uint64)
        self._hash = vocabulary.hashes()[ids]

    def starts(self, length: int) -> np.ndarray:
        """Where a run of length words within a piece, whose last word counts here, starts."""
        n = len(self.ids) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        inside = self.fresh[length - 1 :].copy()
        for k in range(length):
            inside &= self.ids[k : k + n] > 0
        return np.flatnonzero(inside)

    def keys(self, starts: np.ndarray, length: int) -> np.ndarray:
        key = mixed(self._hash[starts] ^ self._lang_hash[self.langs[starts]])
        for k in range(1, length):
            key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + self._hash[starts + k])
        return key

    def phrases(self, starts: np.ndarray, length: int) -> tuple[list[str], list[bytes], np.ndarray]:
        """Language, text and count of the different runs at these places, told apart by their words."""
        code = self.langs[starts].astype(np.int64)
        for k in range(length):
            _, code = np.unique(code, return_inverse=True)
            code = code.astype(np.int64) << 32 | self.ids[starts + k]
        _, first, count = np.unique(code, return_index=True, return_counts=True)
        places, words = starts[first], self.vocabulary.words
        columns = [self.ids[places + k].tolist() for k in range(length)]
        return [self.names[i] for i in self.langs[places].tolist()], [b" ".join([words[i] for i in row]) for row in zip(*columns, strict=True)], count


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK, bite: int = BITE) -> Iterator[Block]:
    """Blocks of about size tokens from batches of (lang, text)."""
    vocabulary, names, number = Vocabulary(), [], {}
    parts: list[tuple[np.ndarray, int, int]] = []
    held = 0

    def block() -> Block:
        lengths = [len(p[0]) for p in parts]
        fresh = np.ones(sum(lengths), bool)
        at = 0
        for (_, _, stale), n in zip(parts, lengths, strict=True):
            fresh[at : at + stale] = False
            at += n
        return Block(np.concatenate([p[0] for p in parts]), np.repeat(np.array([p[1] for p in parts], np.int32), lengths), fresh, names, vocabulary)

    for batch in batches:
        texts = pc.cast(batch.column(1), pa.binary())
        for i, lang in enumerate(batch.column(0).to_pylist()):
            if lang not in number:
                number[lang] = len(names)
                names.append(lang)
            tail = np.zeros(0, np.int64)  # the end of this text's words in blocks that are gone
            for words in bites(texts[i].as_py() or b"", bite):
                ids = np.array([vocabulary[w] for w in words], np.int64)
                stale = 0 if parts else len(tail)
                parts.append((np.concatenate([tail, ids]) if stale else ids, number[lang], stale))
                held += len(ids) + 1
                tail = np.concatenate([tail, ids])[-(LONGEST - 1) :]
                if held >= size:
                    yield block()
                    parts, held = [], 0
                    if len(vocabulary) > VOCABULARY:
                        kept = [vocabulary.words[j] for j in tail.tolist()]
                        vocabulary, names, number = Vocabulary(), [lang], {lang: 0}
                        tail = np.array([vocabulary[w] for w in kept], np.int64)
            if parts:
                parts.append((np.zeros(1, np.int64), number[lang], 0))
    if parts:
        yield block()


class Bitmap:
    """A set of hashes that may say yes too often, never no."""

    def __init__(self, bits: int, at: np.ndarray, masks: np.ndarray):
        self.mask = np.uint64((1 << bits) - 1)
        self.words = np.zeros(1 << (bits - 6), np.uint64)
        self.words[at] = masks

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys & self.mask
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _mask_pass(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64((1 << bits) - 1))
            if len(slots):
                at, first = np.unique(slots >> np.uint64(6), return_index=True)
                masks = np.bitwise_or.reduceat(np.uint64(1) << (slots & np.uint64(63)), first)
                yield pa.record_batch([pa.array(at.astype(np.int64)), pa.array(masks.view(np.int64))], names=["at", "mask"])

    return run


def bitmap(keys: DataFrame, max_bits: int = MAX_BITS) -> Bitmap:
    """A bitmap of the column key; its size follows the number of rows, up to 2 ** max_bits bits."""
    bits = min(max_bits, max(12, (16 * keys.count()).bit_length()))
    table = keys.mapInArrow(_mask_pass(bits), "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    return Bitmap(bits, table.column("at").to_numpy(), table.column("mask").to_numpy().view(np.uint64))


def _word_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, phrase, n, key of the words of each block, and a row without phrase for their number."""
    for block in blocks(batches):
        starts = block.starts(1)
        langs, words, count = block.phrases(starts, 1)
        hashes = [xxhash.xxh64_intdigest(w) ^ xxhash.xxh64_intdigest(x.encode(), 1) for x, w in zip(langs, words, strict=True)]
        keys = mixed(np.array(hashes, np.uint64)).view(np.int64)
        total = np.bincount(block.langs[starts], minlength=len(block.names))
        more = [(name, int(n)) for name, n in zip(block.names, total, strict=True) if n]
        yield pa.record_batch(
            [
                pa.array(langs + [x[0] for x in more], pa.string()),
                pa.array([*words, *[None] * len(more)], pa.binary()).cast(pa.string()),
                pa.array(np.concatenate([count, np.array([x[1] for x in more], np.int64)]).astype(np.int64)),
                pa.array(np.concatenate([keys, np.zeros(len(more), np.int64)])),
            ],
            names=["lang", "phrase", "n", "key"],
        )


def _summary_pass(shared, lengths: tuple[int, ...], parts: int):
    """A summary of each block for each hash partition: keys and counts, packed. Runs count whose words (pairs, where lengths start at 3) are in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, inner = shared.value, lengths[0] - 1
        for block in blocks(batches):
            found = []
            good = _good(block, known, inner)
            for length in lengths:
                starts = block.starts(length)
                for k in range(length - inner + 1):
                    starts = starts[good[starts + k]]
                found.append(block.keys(starts, length))
            keys, count = np.unique(np.concatenate(found), return_counts=True)
            part = (keys % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            keys, count, part = keys[order], count[order].astype(np.uint32), part[order]
            which, first = np.unique(part, return_index=True)
            ends = [*first[1:].tolist(), len(keys)][: len(first)]
            payload = [keys[a:b].tobytes() + count[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)]
            yield pa.record_batch([pa.array(which.astype(np.int32)), pa.array(payload, pa.binary())], names=["part", "summary"])

    return run


def _good(block: Block, known: Bitmap, length: int) -> np.ndarray:
    """For each place, whether a run of length words within a piece starts there that is in the bitmap."""
    n = max(0, len(block.ids) - length + 1)
    inside = np.ones(n, bool)
    for k in range(length):
        inside &= block.ids[k : k + n] > 0
    every = np.flatnonzero(inside)
    good = np.zeros(len(block.ids) + 1, bool)
    good[every] = known.has(block.keys(every, length))
    return good


def merge(summary: tuple[np.ndarray, np.ndarray], keys: np.ndarray, counts: np.ndarray, counters: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """Misra-Gries: the summary with more counts, cut back to so many counters; and what each of them lost."""
    keys, counts = np.concatenate([summary[0], keys]), np.concatenate([summary[1], counts.astype(np.int64)])
    keys, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, counts, len(keys)).astype(np.int64)
    if len(keys) <= counters:
        return (keys, total), 0
    lost = int(np.partition(total, len(total) - counters - 1)[len(total) - counters - 1])
    kept = total > lost
    return (keys[kept], total[kept] - lost), lost


def _merge_group(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for payload in table.column("summary").to_pylist():
            n = len(payload) // 12
            keys.append(np.frombuffer(payload, np.uint64, n))
            counts.append(np.frombuffer(payload, np.uint32, n, 8 * n))
        counters = sum(int(c.sum(dtype=np.int64)) for c in counts) // threshold + 1
        summary, lost = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0
        at = 0
        while at < len(keys):  # many small summaries are merged at once
            end, size = at, 0
            while end < len(keys) and size < max(counters, BLOCK):
                size += len(keys[end])
                end += 1
            summary, less = merge(summary, np.concatenate(keys[at:end]), np.concatenate(counts[at:end]), counters)
            lost += less
            at = end
        return pa.table({"key": pa.array(summary[0][summary[1] + lost >= threshold].view(np.int64))})

    return run


def _count_pass(pairs, longer):
    """lang, phrase, words, n: the phrases whose hashes survived, counted by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            good = _good(block, pairs.value, 2)
            for length in range(2, LONGEST + 1):
                starts = block.starts(length)
                for k in range(length - 1):
                    starts = starts[good[starts + k]]
                if length > 2:
                    starts = starts[longer.value.has(block.keys(starts, length))]
                langs, phrases, count = block.phrases(starts, length)
                yield pa.record_batch(
                    [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.full(len(langs), length, np.int32)), pa.array(count.astype(np.int64))],
                    names=["lang", "phrase", "words", "n"],
                )

    return run


def frequent(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Written tables: lang, phrase, words, a of every word and phrase with threshold places or more; and lang, n of every language."""
    spark: SparkSession = docs.sparkSession
    share = spark.sparkContext.broadcast
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = texts.mapInArrow(_word_pass, "lang string, phrase string, n long, key long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.max("key").alias("key"))
    words = common.spill(counted.filter((F.col("n") >= threshold) | F.col("phrase").isNull()), "words")[0]
    totals = words.filter("phrase is null").select("lang", "n")
    words = words.filter("phrase is not null")
    mass = totals.agg(F.sum("n")).first()[0] or 0

    def survivors(known: Bitmap, lengths: tuple[int, ...], name: str) -> DataFrame:
        parts = max(common.shuffle_partitions(spark), mass * len(lengths) // PART_MASS + 1)
        summaries = texts.mapInArrow(_summary_pass(share(known), lengths, parts), "part int, summary binary")
        return common.spill(summaries.groupBy("part").applyInArrow(_merge_group(threshold), "key long"), name)[0]

    pairs = bitmap(survivors(bitmap(words.select("key")), (2,), "pairs"))
    longer = bitmap(survivors(pairs, tuple(range(3, LONGEST + 1)), "longer"))
    exact = texts.mapInArrow(_count_pass(share(pairs), share(longer)), "lang string, phrase string, words int, n long")
    exact = exact.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("a")).filter(F.col("a") >= threshold)
    phrases = words.select("lang", "phrase", F.lit(1).alias("words"), F.col("n").alias("a")).unionByName(exact)
    return common.spill(phrases, "phrases")[0], totals


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates that aren't part of a longer one as frequent."""
    candidates = phrases.filter("words > 1").withColumn("w", F.split("phrase", " "))
    longer = candidates.filter("words > 2")
    inner = longer.select("lang", "a", F.explode(F.array(F.expr("array_join(slice(w, 1, words - 1), ' ')"), F.expr("array_join(slice(w, 2, words - 1), ' ')"))).alias("phrase"))
    candidates = candidates.join(inner, ["lang", "phrase", "a"], "left_anti")
    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.withColumn("head", F.expr("array_join(slice(w, 1, k), ' ')")).withColumn("rest", F.expr("array_join(slice(w, k + 1, words - k), ' ')"))
    table = phrases.select("lang", "phrase", "a")
    cuts = cuts.join(table.toDF("lang", "head", "l"), ["lang", "head"]).join(table.toDF("lang", "rest", "r"), ["lang", "rest"]).join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "n", "l", "r")}
    product = (wide["a"] * wide["n"]).cast("decimal(36,0)") * F.lit(1000).cast("decimal(4,0)")
    cuts = cuts.withColumn("product", product).withColumn("parts", (wide["l"] * wide["r"]).cast("decimal(36,0)"))
    best = F.min(F.struct(F.expr("product div parts").alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def mine(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first top phrases of each language, written."""
    with common.workspace(docs.sparkSession) as result:
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
        ranked = scored(*frequent(docs, threshold)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        return result(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
