"""Similarity join of documents by the Jaccard coefficient of their word shingles (PartEnum).

A document's set holds the distinct 5-word shingles of its text, A-Z lower-cased (the
whole sequence if it has fewer words; none without words). Documents link when
100 * |intersection| >= 75 * |union|; equal sets are one class and join as one.

Signatures. Sets of sizes a <= b link only if b <= 4a/3 and at most (a + b) / 7 shingles
are in one of them but not the other. Sizes fall into bands [2^j, 2^(j+1)), and a set that
could link to a smaller one of the band below also signs for that band. In a band the
domain of shingles is cut into n parts by a hash; a signature is the content of one
part. Two linked sets differ in k parts at most, so among the first k + 1 parts (in a
fixed order) that are not empty in a set, one is the same in both, and it is among the
first k + 1 of the other set too. So each set signs its first k + 1 non-empty parts. If
it has k or fewer, or belongs to a band up to ``SMALL``, it is also cut as finely as can be, one
shingle to a part: among its first k + 2 shingles (in a fixed order) are two that the
other set has among its own first k + 2, as linked sets share three shingles at least.
So it signs each subset of two of them, which covers the pairs where both have few
parts. Hence linked sets share a signature: no link is lost. No signature is that of an
empty part, which unrelated short texts would have in common; sets of one or two shingles link
to no other set, and sign as a whole.

Common shingles. Passages that many texts share would put all these texts into the same
buckets. Leaving any set of shingles out of all sets brings no two sets further apart, so
the parts are formed without shingles that are common in a sample (a sixteenth of the
classes, ``MAX_COMMON`` shingles at most); a set that then has k non-empty parts or
fewer signs these, and signs in full, under other names, for the pairs where both are so.
Subsets of two take common shingles last.
Which shingles are left out changes the buckets, never the links.

Verification. A signature's classes form a bucket, and equal buckets are one. A bucket is
led by the class that is in most buckets, as a text that many others were made from shares
more with them than they share with one another; the classes of all buckets with one
leader form a star. Each pair that shares a bucket is in one star at least. A star goes to
one cell, where its classes are compared; a star that is too large for a cell is cut into
tiles, and a cell compares two tiles:

1. Large stars only: each class is compared with the leader. Classes linked to it are
   connected already, so that only pairs with a class that isn't remain to be compared.
2. Bitmaps of the sets rule out classes that can link to none in their star, exactly: two
   bitmaps never differ in more bits than their sets do in shingles.
3. The sets of the classes that remain are compared. A cell returns the links that span
   its components, fewer than it has classes, and never pairs of candidates.

A class with over a ``HEAVY``-th of all rows gets its component by a broadcast of these few
classes, and rows without words get theirs without a join, so that no task holds all copies of a text.

Each pair that shares a bucket is thus compared, ruled out exactly, or connected through a
leader, so that components are exact.

Shingles, classes, signatures and buckets are 64-bit hashes; of a signature its part and 40 bits are sent. Sets travel only for classes
that bitmaps can't rule out. Defined cases: null text is empty; a document without words
has no shingles and is a component of its own; a row without doc_id links like any other,
and gets the smallest doc_id of its component, null if there is none; repeated rows fall
into one class; rows with one doc_id and different texts are each compared; a text of any
length is one set; an empty table gives no rows; extra columns aren't read by
``link_components`` and are carried by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm import common
from aerolith.llm.components import components
from aerolith.llm.tokenize import forget_encoders

WIDTH = 5
NUMERATOR, DENOMINATOR = 75, 100
BROADCAST_IDS = 2_000_000
#: Bands of small sets, whose parts hold one shingle each.
SMALL = 3
#: Classes with more than this part of all rows are heavy; there are fewer than HEAVY.
HEAVY = 1_000
SAMPLE = 16
COMMON_IN_SAMPLE = 4
MAX_COMMON = 1_000_000
PART_BYTES = 48 << 20
CACHE = 200_000
#: Rows of an Arrow batch: of texts, and of sets.
TEXT_ROWS, SET_ROWS = 1_000, 250
#: A tile's classes, and their shingles in all, at most (on average).
TILE_ROWS, TILE_SHINGLES = 256, 1 << 18
COLUMNS = 4096
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_ALL = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def shingles(text: bytes | None, words: dict) -> np.ndarray:
    """The sorted hashes of a text's set."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.array([words[x] for x in found], np.uint64)
    width = min(WIDTH, len(w))
    n = len(w) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = h * _P + w[k : k + n]
    return np.unique(_mix(h))


def class_key(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def _bounds(size: int, band: int) -> int:
    """The most shingles by which a set of this size differs from one that links to it and is compared in the band."""
    largest = size * DENOMINATOR // NUMERATOR
    if size >= 2 << band:  # it is compared here with sets of this band only
        largest = (2 << band) - 1
    return (size + largest) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def parts_of(band: int) -> int:
    top = ((2 << band) - 1) * DENOMINATOR // NUMERATOR
    return max(4 * (1 << band) // 5, max(_bounds(s, band) for s in ((2 << band) - 1, top)) + 1)


def _parts(found: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The non-empty parts of a set, in order, and a hash of the content of each."""
    if not len(found):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    part = ((found >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return part[starts], np.add.reduceat(_mix(found ^ _Q), starts)


def without(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A sorted set without the members of another."""
    if not len(common):
        return found
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    return found[common[at] != found]


def signatures(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The signatures of a set, for its own band and for the one below if it may link to a smaller set there."""
    size = len(found)
    if size < 3:  # it links to its equals only
        return _mix(np.array([int(found.sum()) + size], np.uint64)) if size else found
    own = size.bit_length() - 1
    bands = [own] + ([own - 1] if -(-size * NUMERATOR // DENOMINATOR) < 1 << own else [])
    rare = without(found, common)
    out = []
    for band in bands:
        most = _bounds(size, band)
        first, other, pairs = (np.uint64((3 * band + i) * int(_Q) & _ALL) for i in range(1, 4))
        if band <= SMALL:
            out.append(_subsets(found, rare, most + 2, pairs))
            continue
        filled, content = _parts(rare, parts_of(band))
        out.append(_mix(content[: most + 1] + filled[: most + 1] * _P + first))
        if len(filled) <= most:
            filled, content = _parts(found, parts_of(band))
            out.append(_mix(content[: most + 1] + filled[: most + 1] * _P + other))
            if len(filled) <= most:
                out.append(_subsets(found, rare, most + 2, pairs))
    return np.concatenate(out)


def _subsets(found: np.ndarray, rare: np.ndarray, n: int, name: np.uint64) -> np.ndarray:
    """The signatures of each two of the first n shingles of a set, rare ones first."""
    first = rare[:n]
    if len(first) < n:
        first = np.concatenate([first, without(found, rare)[: n - len(first)]])
    content = _mix(first ^ _Q)
    i, j = np.triu_indices(len(first), 1)
    return _mix(content[i] + content[j] + name)


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    same = intersection(a, b)
    return bool(len(a)) and DENOMINATOR * same >= NUMERATOR * (len(a) + len(b) - same)


def bitmap(found: np.ndarray) -> bytes:
    """A bit for each shingle, by its low bits; twice as many bits as the band is wide."""
    bits = max(256, 2 << max(len(found).bit_length(), 1))
    out = np.zeros(bits, np.uint8)
    out[(found & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _class_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_encoders()
    words = _Words()
    for batch in batches:
        sizes, keys, sample, seen = [], [], [], set()
        for text in pc.cast(batch.column(1), pa.binary()).to_pylist():
            found = shingles(text, words)
            sizes.append(len(found))
            keys.append(class_key(found) if len(found) else None)
            take = len(found) and keys[-1] % SAMPLE == 0 and keys[-1] not in seen
            if take:
                seen.add(keys[-1])
            sample.append(found.astype(np.int64) if take else None)
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(sample, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "key", "sample"])


def _dealt(sigs: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each signature, and 40 bits of the rest of it, which tell it apart in its part.

    Parts hold some million signatures whatever the corpus, so that very few meet another one by chance; their classes are then compared.
    """
    n = np.uint64(parts)
    return (sigs % n).astype(np.int64), sigs // n & np.uint64((1 << 40) - 1)


def _packed(sigs: np.ndarray) -> bytes:
    """Five bytes of each: the low four of all, then the fifth."""
    return sigs.astype("<u4").tobytes() + (sigs >> np.uint64(32)).astype(np.uint8).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 5
    return np.frombuffer(data, "<u4", n).astype(np.int64) | np.frombuffer(data, np.uint8, n, 4 * n).astype(np.int64) << 32


def _signature_pass(parts: int, shared):
    """Signatures and classes, packed together for each part of the signatures' range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        words, common = _Words(), shared.value
        for batch in batches:
            done: dict[int, np.ndarray] = {}
            for text in pc.cast(batch.column(0), pa.binary()).to_pylist():
                found = shingles(text, words)
                if len(found) and (key := class_key(found)) not in done:
                    done[key] = signatures(found, common)
            if not done:
                continue
            sigs = np.concatenate(list(done.values()))
            keys = np.repeat(np.array(list(done), np.int64), [len(s) for s in done.values()])
            part, sigs = _dealt(sigs, parts)
            order = np.argsort(part, kind="stable")
            sigs, keys = sigs[order], keys[order]
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            full = np.flatnonzero(edges[1:] > edges[:-1])
            yield pa.record_batch(
                [
                    pa.array(full, pa.int32()),
                    pa.array([_packed(sigs[edges[p] : edges[p + 1]]) for p in full], pa.binary()),
                    pa.array([keys[edges[p] : edges[p + 1]].tobytes() for p in full], pa.binary()),
                ],
                names=["part", "sigs", "keys"],
            )

    return run


def _in_company(s: np.ndarray) -> np.ndarray:
    """Which members of a sorted array occur more than once."""
    edge = s[1:] == s[:-1]
    return np.concatenate([[False], edge]) | np.concatenate([edge, [False]]) if len(s) else np.zeros(0, bool)


def _bucket_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, key of the signatures that more than one class has; a bucket is named by its classes."""
    sigs, keys = [], []
    for batch in batches:
        sigs += [_unpacked(x) for x in batch.column(1).to_pylist()]
        keys += [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
    if not sigs:
        return
    s, k = np.concatenate(sigs), np.concatenate(keys)
    sigs.clear()
    keys.clear()
    order = np.argsort(s, kind="stable")
    s, k = s[order], k[order]
    shared = _in_company(s)
    s, k = s[shared], k[shared]
    order = np.lexsort((k, s))
    s, k = s[order], k[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (k[1:] != k[:-1])
    s, k = s[new], k[new]
    shared = _in_company(s)
    s, k = s[shared], k[shared]
    if not len(s):
        return
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    count = np.diff(np.append(starts, len(s)))
    names = _mix(np.add.reduceat(_mix(k.view(np.uint64)), starts) + count.astype(np.uint64) * _Q)
    first = np.zeros(len(starts), bool)
    first[np.unique(names, return_index=True)[1]] = True
    rows = np.repeat(first, count)
    bucket, k = np.repeat(names.view(np.int64), count)[rows], k[rows]
    for at in range(0, len(k), 1 << 16):
        yield pa.record_batch([pa.array(bucket[at : at + (1 << 16)]), pa.array(k[at : at + (1 << 16)])], names=["bucket", "key"])


def _set_pass(sketch: bool):
    """key, n and the bitmap or the set of each text whose class is the one that it was sent for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary()).to_pylist(), strict=True):
                found = shingles(text, words)
                if len(found) and key in (None, own := class_key(found)):  # else another text under the same doc_id
                    rows.append((own, len(found), bitmap(found) if sketch else found.tobytes()))
            keys, n, data = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["key", "n", "data"])

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one cell at a time; they come sorted by cell."""
    carried: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy()
        edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if carried and carried[-1].column("cell")[0] != batch.column("cell")[lo]:
                yield pa.Table.from_batches(carried)
                carried = []
            carried.append(batch.slice(lo, hi - lo))
    if carried:
        yield pa.Table.from_batches(carried)


def _sides(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the classes to be compared, and of those to compare them with; a star that fits into one cell is both."""
    side, opened = cell.column("side").to_numpy(), cell.column("open").to_numpy()
    return np.flatnonzero((side == 0) | ((side == 2) & opened)), np.flatnonzero(side > 0)


def _sketch_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """leader, key, n, open of the classes that bitmaps can't rule out."""
    for cell in _cells(batches):
        keys, n = cell.column("key").to_numpy(), cell.column("n").to_numpy()
        words = [np.frombuffer(b, np.uint64) for b in cell.column("data").to_pylist()]
        width = min(len(w) for w in words)
        folded = np.stack([np.bitwise_or.reduce(w.reshape(-1, width), axis=0) for w in words])
        left, right = _sides(cell)
        keep = np.zeros(len(n), bool)
        for i in left:
            j = right[(keys[right] != keys[i]) & (np.minimum(n[right], n[i]) * DENOMINATOR >= np.maximum(n[right], n[i]) * NUMERATOR)]
            apart = np.bitwise_count(folded[j] ^ folded[i]).sum(1, dtype=np.int64)
            j = j[apart * (DENOMINATOR + NUMERATOR) <= (n[j] + n[i]) * (DENOMINATOR - NUMERATOR)]
            keep[j] = True
            keep[i] |= len(j) > 0
        if keep.any():
            rows = cell.select(["leader", "key", "n", "open"]).filter(pa.array(keep)).combine_chunks()
            yield from rows.to_batches()


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of each set on the left with each on the right."""
    members = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, column, times = np.unique(members, return_inverse=True, return_counts=True)
    often = times > 1
    seen = often[column]
    row, column = row[seen], (np.cumsum(often) - 1)[column[seen]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, int(often.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        block = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        block[row[lo:hi], column[lo:hi] - at] = 1
        out += block[: len(left)] @ block[len(left) :].T
    return out.astype(np.int64)


def _links(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of a set on the left and one on the right that link."""
    if len(left) * len(right) <= 4:
        same = np.array([[intersection(x, y) for y in right] for x in left])
    else:
        same = _shared_counts(left, right)
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(y) for y in right])
    return np.nonzero(DENOMINATOR * same >= NUMERATOR * (sizes - same))


def _span(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest node of each node's component."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[a], low[b])
        after = low.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == low).all():
            return low
        low = after


def _link_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """leader, a, b: links that span the components of each cell."""
    for cell in _cells(batches):
        sets = [np.frombuffer(x, np.uint64) for x in cell.column("data").to_pylist()]
        left, right = _sides(cell)
        if not len(left) or not len(right):
            continue
        i, j = _links([sets[x] for x in left], [sets[x] for x in right])
        keys, node = np.unique(cell.column("key").to_numpy(), return_inverse=True)
        low = _span(len(keys), node[left[i]], node[right[j]])
        b = np.flatnonzero(low != np.arange(len(keys)))
        if len(b):
            yield pa.record_batch([pa.array([cell.column("leader")[0].as_py()] * len(b), pa.int64()), pa.array(keys[low[b]]), pa.array(keys[b])], names=["leader", "a", "b"])


def _stars(buckets: DataFrame) -> DataFrame:
    """leader, key: the classes of all buckets that a class leads, itself among them."""
    weight = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("w"))
    leaders = buckets.join(weight, "key").groupBy("bucket").agg(F.max(F.struct("w", "key")).alias("l")).select("bucket", F.col("l.key").alias("leader"))
    return buckets.join(leaders, "bucket").select("leader", "key").distinct()


def _tiles(rows: DataFrame) -> DataFrame:
    """For each leader in how many tiles its star is cut, and in how many the open part of it."""
    def tiles(only):
        n, shingles_ = F.count_if(only), F.coalesce(F.sum(F.when(only, F.col("n"))), F.lit(0))
        return F.least(n, F.greatest(F.ceil(n / TILE_ROWS), F.ceil(shingles_ / TILE_SHINGLES))).cast("int")

    return rows.groupBy("leader").agg(tiles(F.lit(True)).alias("of_all"), tiles(F.col("open")).alias("of_open"))


def _compared(rows: DataFrame, data: DataFrame, run, schema: str, parts: int) -> DataFrame:
    """The classes of each star (leader, key, n, open) dealt to cells with their data, and what ``run`` makes of the cells."""
    rows = rows.join(_tiles(rows).filter("of_open > 0"), "leader")
    def place(side, i, j):
        return F.struct(F.lit(side).cast("byte").alias("side"), i.cast("int").alias("i"), j.cast("int").alias("j"))

    def upto(n):
        return F.sequence(F.lit(0), n - 1)

    own = lambda n: F.pmod(F.xxhash64("key"), n)
    as_any = F.transform(upto(F.col("of_open")), lambda i: place(1, i, own(F.col("of_all"))))
    as_open = F.transform(upto(F.col("of_all")), lambda j: place(0, own(F.col("of_open")), j))
    places = F.when(F.col("of_all") == 1, F.array(place(2, F.lit(0), F.lit(0)))).when(F.col("open"), F.concat(as_any, as_open)).otherwise(as_any)
    rows = rows.select("leader", "key", "n", "open", F.explode(places).alias("p")).select("leader", "key", "n", "open", "p.side", F.xxhash64("leader", "p.i", "p.j").alias("cell"))
    dealt = rows.join(data.select("key", "data"), "key").repartition(parts, "cell").sortWithinPartitions("cell")
    with common.batch_rows(rows.sparkSession, SET_ROWS):
        return common.spill(dealt.mapInArrow(run, schema), "compared")[0]


def _head_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, text of one row of each class of wanted (key, first); rows without doc_id come with a null key for their own."""
    few = wanted.count() <= BROADCAST_IDS  # 16 bytes each
    heads = wanted.filter("first is not null").select("key", F.col("first").alias("doc_id"))
    return rows.join(F.broadcast(heads) if few else heads, "doc_id").select("key", "text").unionByName(rows.filter("doc_id is null").select(F.lit(None).cast("long").alias("key"), "text"))


def _sets(rows: DataFrame, wanted: DataFrame, sketch: bool) -> DataFrame:
    """key, n and data (bitmap or set) of the wanted classes, written."""
    found = _head_texts(rows, wanted).mapInArrow(_set_pass(sketch), "key long, n long, data binary")
    found = common.spill(found, "sets")[0]
    if found.count() == wanted.count():
        return found
    found = found.join(wanted.select("key"), "key", "left_semi")  # rows without doc_id, or that repeat one
    return common.spill(found.dropDuplicates(["key"]), "sets")[0]


def _all_links(rows: DataFrame, classes: DataFrame, buckets: DataFrame, parts: int) -> DataFrame:
    """a, b: pairs of classes that connect all classes that links connect."""
    with_heads = lambda keys: common.spill(keys.select("key").distinct().join(classes, "key"), "wanted")[0]
    links, stars_of = "leader long, a long, b long", "leader long, key long, n long, open boolean"
    sketches = _sets(rows, with_heads(buckets), sketch=True)
    stars = common.spill(_stars(buckets).join(sketches.select("key", "n"), "key"), "stars")[0]
    large = _tiles(stars.withColumn("open", F.lit(True))).filter("of_all > 1").select("leader", F.lit(True).alias("large"))
    large = common.spill(large, "large")[0]
    around = common.spill(stars.join(large, "leader").select("leader", "key", "n", (F.col("key") == F.col("leader")).alias("open")), "around")[0]
    led = _compared(around, _sets(rows, with_heads(around), sketch=False), _link_pass, links, parts)
    settled = led.select("leader", F.explode(F.array("a", "b")).alias("key")).union(around.filter("open").select("leader", "key")).distinct()
    stars = stars.join(settled.withColumn("settled", F.lit(True)), ["leader", "key"], "left").select("leader", "key", "n", F.col("settled").isNull().alias("open"))
    left = _compared(stars, sketches, _sketch_pass, stars_of, parts).distinct()
    left = common.spill(left, "left")[0]
    return led.union(_compared(left, _sets(rows, with_heads(left), sketch=False), _link_pass, links, parts)).select("a", "b")


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    with common.batch_rows(docs.sparkSession, TEXT_ROWS), common.workspace(docs.sparkSession) as result:
        return result(_link_components(docs), "components")


def _link_components(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = common.spill(rows.mapInArrow(_class_pass, "doc_id long, n_shingles long, key long, sample array<long>"), "classes")[0]
    frequent = table.select(F.explode("sample").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    frequent = frequent.filter(F.col("n") >= COMMON_IN_SAMPLE).orderBy(F.desc("n"), "s").limit(MAX_COMMON).select("s").toArrow()
    common_shingles = spark.sparkContext.broadcast(np.sort(frequent.column(0).to_numpy().astype(np.uint64)))
    table = table.drop("sample")
    classes = table.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    classes = common.spill(classes, "class-heads")[0]

    total, n_rows = table.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(common.shuffle_partitions(spark), -(-8 * int(total) // PART_BYTES))
    dealt = rows.select("text").mapInArrow(_signature_pass(parts, common_shingles), "part int, sigs binary, keys binary").repartitionById(parts, F.col("part"))
    buckets = dealt.mapInArrow(_bucket_pass, "bucket long, key long").dropDuplicates(["bucket", "key"])
    buckets = common.spill(buckets, "buckets")[0]
    roots = components(_all_links(rows, classes, buckets, parts), "a", "b")

    members = roots.withColumnRenamed("node", "key").join(classes, "key")
    lowest = members.groupBy("root").agg(F.min("first").alias("component"))
    merged = members.join(lowest, "root").select("key", "component")
    named = classes.join(merged, "key", "left").select("key", "rows", F.coalesce("component", "first").alias("component"))
    named = common.spill(named, "named")[0]
    heavy = F.col("rows") > n_rows // HEAVY
    few = F.broadcast(named.filter(heavy).select("key", "component"))
    worded = table.filter("key is not null")
    out = worded.join(few, "key").union(worded.join(few, "key", "left_anti").join(named.filter(~heavy).select("key", "component"), "key"))
    out = out.union(table.filter("key is null").withColumn("component", F.lit(None).cast("long")).select(out.columns))
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs with the smallest doc_id of their component, all columns; every row without doc_id."""
    drop = common.unused(docs.columns, "drop")
    rows = link_components(docs).filter("component_id <> doc_id").select(F.col("doc_id").alias(drop)).distinct()
    few = rows.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(rows) if few else rows, docs["doc_id"].cast("long") == rows[drop], "left_anti")
