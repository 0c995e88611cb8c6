"""Line labelling by a linear-chain conditional random field, with quality rules.

The rules of a document: n_words, word_chars, n_symbols, n_dup_lines and
n_repeat_words, and base_failed (too few words, or over half of them in repeated
3-word windows). A document that they pass is judged by its lines: a linear-chain CRF
labels each line with a word as content (0) or boilerplate (1), decoded by Viterbi;
the document is kept if at least ``min_content`` of the characters of its lines are
content.

The CRF has weights for (feature, label), (label, label) and the first label. Its
features are buckets of a line's shape: length, capitals, digits, marks at word ends,
separators, repeated words, equality to an earlier line, legal and navigation words.
It is fitted by gradient ascent on the conditional log-likelihood over the documents
of the labels table: lines of low-quality documents and lines repeated in a document are
boilerplate, all others content. Bounds: about
``train_rows`` labelled rows, chosen by a hash of doc_id, and fewer of them if their texts
hold over ``TRAIN_BYTES``; each is learned from whole, and every row is scored on its
whole text. Defined cases: a null or empty text fails the rules; with no labelled row
the weights are 0, and every line counts as content; a line that both labels explain equally
well is content; repeated rows and rows without doc_id each give their row; a text of any
length is labelled whole; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

MIN_CONTENT = 0.5
TRAIN_ROWS = 3_000
TRAIN_BYTES = 64 << 20
EPOCHS = 150
_BUCKETS = 6
_RATIOS = ("upper", "digit", "marked", "separator", "run", "distinct")
_FLAGS = ("bias", "repeat", "stop", "legal", "first")
N_FEATURES = len(_FLAGS) + _BUCKETS * (len(_RATIOS) + 1)
_LEGAL = re.compile(rb"licen[sc]e|copyright|rights reserved|cookie|subscribe|click here|terms of|privacy")
_MARKED = re.compile(rb"(?:[#*$%&|<>~^=+_]|!!)(?= |$)")
_UPPER, _DIGIT = bytes(range(65, 91)), b"0123456789"
_CONTINUATION = bytes(range(0x80, 0xC0))


def base_rules(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()
    joined = b"".join(words)
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return len(words), len(joined.translate(None, _CONTINUATION)), len(text) - len(text.translate(None, SYMBOLS)), dup, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows found twice or more in the text, the first time included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    pairs = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
    windows = pairs[:-1] * len(ids) + w[2:]
    _, at, counts = np.unique(windows, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(counts[at] >= 2)
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[hit + k] = True
    return int(cover.sum())


def _bucket(share: float) -> int:
    return min(_BUCKETS - 1, int(share * _BUCKETS))


def line_features(text: bytes) -> tuple[list[list[int]], list[int]]:
    """Feature numbers of each line with a word, and the lines' lengths."""
    rows, sizes, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        row = [0]
        if line in seen:
            row.append(1)
        seen.add(line)
        if line.rstrip()[-1:] in b".?!\"":
            row.append(2)
        if _LEGAL.search(line.lower()):
            row.append(3)
        if not rows:
            row.append(4)
        runs = sum(map(bytes.__eq__, words, words[1:]))
        ratios = (
            (size - len(line.translate(None, _UPPER))) / size,
            (size - len(line.translate(None, _DIGIT))) / size,
            len(_MARKED.findall(line)) / n,
            min(1.0, 3 * line.count(b"|") / n),
            runs / n,
            len(set(words)) / n,
        )
        at = len(_FLAGS)
        for r in ratios:
            row.append(at + _bucket(r))
            at += _BUCKETS
        row.append(at + min(_BUCKETS - 1, size.bit_length() // 2))
        rows.append(row)
        sizes.append(size)
    return rows, sizes


def row_labels(rows: list[list[int]], quality: int) -> list[int]:
    """Labels to learn from: all lines of a document of low quality are boilerplate, and in others those that repeat an earlier one."""
    return [int(quality == 0 or 1 in row) for row in rows]


class LineCrf:
    """Two labels; weights of features, transitions and the start."""

    def __init__(self):
        self.emit, self.move, self.start = np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        edges = np.cumsum([0] + [len(r) for r in rows[:-1]])
        return np.add.reduceat(self.emit[np.fromiter((f for r in rows for f in r), np.int64)], edges, axis=0)

    def viterbi(self, docs: list[list[list[int]]]) -> list[np.ndarray]:
        """The best labels of each document's lines; documents advance together, a line at a time."""
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        out = [np.zeros(0, np.int64)] * len(docs)
        order = [i for i in order if docs[i]]
        if not order:
            return out
        lengths = np.array([len(docs[i]) for i in order])
        flat = self.scores([row for i in order for row in docs[i]])
        first = np.cumsum(lengths) - lengths
        best = self.start + flat[first]
        final = best.copy()
        back = []
        for t in range(1, lengths[0]):
            live = int(np.searchsorted(-lengths, -t, side="left"))  # documents with a line t
            path = best[:live, :, None] + self.move[None]
            came = path.argmax(1)
            best = path.max(1) + flat[first[:live] + t]
            back.append(came)
            final[:live] = best
        label = final.argmax(1)
        paths = [[x] for x in label]
        for t in range(int(lengths[0]) - 1, 0, -1):
            came = back[t - 1]
            live = len(came)
            label[:live] = came[np.arange(live), label[:live]]
            for i in range(live):
                paths[i].append(label[i])
        for i, path in zip(order, paths, strict=True):
            out[i] = np.array(path[::-1])
        return out

    def fit(self, docs: list[list[list[int]]], labels: list[list[int]], epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-3) -> LineCrf:
        """Adam on the mean conditional log-likelihood, by forward-backward over all documents at once."""
        keep = sorted((i for i in range(len(docs)) if docs[i]), key=lambda i: -len(docs[i]))
        if not keep:
            return self
        docs, labels = [docs[i] for i in keep], [labels[i] for i in keep]
        lengths = np.array([len(d) for d in docs])
        n = int(lengths.sum())
        first = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(n), [len(r) for d in docs for r in d])
        feature = np.fromiter((f for d in docs for r in d for f in r), np.int64)
        gold = np.eye(2)[np.concatenate(labels)]
        live = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(lengths[0])]
        seen_move, seen_start = np.zeros((2, 2)), gold[first].sum(0)
        for t in range(1, lengths[0]):
            seen_move += gold[first[: live[t]] + t - 1].T @ gold[first[: live[t]] + t]
        p = np.zeros(2 * N_FEATURES + 6)
        m, v = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, epochs + 1):
            emit, move, start = p[: 2 * N_FEATURES].reshape(-1, 2), p[2 * N_FEATURES : -2].reshape(2, 2), p[-2:]
            score = np.stack([np.bincount(owner, emit[feature, y], n) for y in (0, 1)], axis=1)
            alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
            alpha[first] = start + score[first]
            for t in range(1, lengths[0]):
                at = first[: live[t]] + t
                alpha[at] = np.logaddexp.reduce(alpha[at - 1][:, :, None] + move, axis=1) + score[at]
            for t in range(lengths[0] - 2, -1, -1):
                at = first[: live[t + 1]] + t
                beta[at] = np.logaddexp.reduce(move[None] + (score[at + 1] + beta[at + 1])[:, None, :], axis=2)
            z = np.logaddexp.reduce(alpha[first + lengths - 1], axis=1)
            per_line = np.repeat(z, lengths)
            marginal = np.exp(alpha + beta - per_line[:, None])
            moves = np.zeros((2, 2))
            for t in range(1, lengths[0]):
                at = first[: live[t]] + t
                moves += np.exp(alpha[at - 1][:, :, None] + move + (score[at] + beta[at])[:, None, :] - per_line[at][:, None, None]).sum(0)
            gap = gold - marginal
            grad = np.concatenate([np.stack([np.bincount(feature, gap[owner, y], N_FEATURES) for y in (0, 1)], axis=1).ravel(), (seen_move - moves).ravel(), seen_start - marginal[first].sum(0)]) / n - decay * p
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            p = p + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.emit, self.move, self.start = p[: 2 * N_FEATURES].reshape(-1, 2).copy(), p[2 * N_FEATURES : -2].reshape(2, 2).copy(), p[-2:].copy()
        return self


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> LineCrf:
    """Fit on all lines of about train_rows labelled documents, chosen by a hash of doc_id; on fewer of them if they hold over TRAIN_BYTES."""
    rated = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = rated.count()
    if not total:
        return LineCrf()
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("lines")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rated.filter(draw < min(1.0, train_rows / total)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", F.col("text").cast("binary").alias("text"))
    found, size = [], 0
    for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").toLocalIterator():
        size += len(r["text"] or b"")
        if found and size > TRAIN_BYTES:
            break
        found.append((r["doc_id"], r["quality"], line_features(bytes(r["text"] or b""))[0]))
    found.sort(key=lambda x: x[0])
    lines = [x for _, _, x in found]
    return LineCrf().fit(lines, [row_labels(x, q) for _, q, x in found])


def _judge_pass(shared, min_content: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            texts = [t or b"" for t in pc.cast(batch.column(1), pa.binary()).to_pylist()]
            rules = [base_rules(t) for t in texts]
            failed = [r[0] < MIN_WORDS or 100 * r[4] > MAX_REPEAT_PERCENT * r[0] for r in rules]
            lines, sizes = zip(*[line_features(t) for t in texts], strict=True) if texts else ((), ())
            share = []
            for path, size in zip(crf.viterbi(list(lines)), sizes, strict=True):
                total = sum(size)
                share.append(float(np.array(size)[path == 0].sum() / total) if total else 0.0)
            kept = [not f and s >= min_content for f, s in zip(failed, share, strict=True)]
            columns = [pa.array([r[k] for r in rules], pa.int64()) for k in range(5)]
            yield pa.record_batch(
                [batch.column(0), *columns, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(share, pa.float64())],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"],
            )

    return run


def judge(docs: DataFrame, labels: DataFrame, min_content: float = MIN_CONTENT, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rules and the verdict for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_rows))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_judge_pass(shared, min_content), schema)
