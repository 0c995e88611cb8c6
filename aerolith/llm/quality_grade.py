"""Quality grades by ordinal cumulative-link regression on hashed text.

A document has a rating from 0 to K - 1. One weight vector over hashed features is
shared by all grades; ordered thresholds t_1 < ... < t_{K-1} cut its score, so that
P(grade >= k) = sigmoid(w.x - t_k). The expected grade is the sum of these tails, and
the tail of ``select_grade`` decides the selection.

Features of the whole text, hashed to ``2 ** BITS`` weights: its words, A-Z
lower-cased and stripped of punctuation, the beginning of each word (which words of one
stem share), and its shape (case, marks around it, repeat of the word before). A feature
counts log(1 + n), and the vector is scaled to length 1; words, beginnings and shapes are
scaled apart, so that none hides the others.

Ratings come from the labels table: 0 for low quality, 1 for toxic, 2 for others.
Bounds: the model is fitted on about ``train_rows`` rated rows, chosen by a hash of
doc_id; every row is scored. Defined cases: null and empty texts have no features
and get the grade that the thresholds alone give; a document rated more than once
counts with its lowest rating; without any rated row all tails are 0.5; a tail of just 0.5
selects; repeated rows and rows without doc_id each give their row; a text of any length is
read whole; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 17
GRADES = 3
TRAIN_ROWS = 10_000
SELECT_GRADE = 2
SEED = 7
CACHE = 300_000
#: Bytes of a word that make its beginning.
BEGINNING = 4
_CORE = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _slot(kind: bytes, key: bytes) -> int:
    return xxhash.xxh64_intdigest(kind + key) & ((1 << BITS) - 1)


class Hasher(dict):
    """Word -> (slots of the word, of its shape and of its beginning); bounded, as it starts anew when full."""

    def __missing__(self, word: bytes) -> tuple[int, int, int]:
        if len(self) > CACHE:
            self.clear()
        core = b" ".join(_CORE.findall(word))
        case = b"A" if core[:2].isupper() and len(core) > 1 else b"a"
        digits = b"9" if any(48 <= c < 58 for c in core) else b""
        around = _CORE.sub(b"w", word)[:12]
        lower = core.lower()
        out = self[word] = (_slot(b"w", lower), _slot(b"s", case + digits + around), _slot(b"b", lower[:BEGINNING]))
        return out


def features(text: bytes | None, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text."""
    words = (text or b"").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    pairs = np.array([hasher[w] for w in words], np.int64)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    parts = []
    for column, more in ((0, None), (1, repeats), (2, None)):
        slots, n = np.unique(pairs[:, column], return_counts=True)
        values = np.log1p(n)
        if more:
            slots, values = np.append(slots, _slot(b"r", b"")), np.append(values, np.log1p(more))
        parts.append((slots, values / np.sqrt((values**2).sum())))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class Ordinal:
    """Cumulative-link (proportional odds) regression."""

    def __init__(self, grades: int = GRADES):
        self.weights = np.zeros(1 << BITS)
        self.first, self.gaps = 0.0, np.zeros(grades - 2)  # thresholds: first, then exp(gap) apart

    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))])

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K - 1."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds(), -40, 40)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, epochs: int = 30, rate: float = 0.05, decay: float = 1e-4) -> Ordinal:
        """Adam on the mean negative log-likelihood, rare grades weighed more, in mini-batches in a seeded order."""
        rng = np.random.default_rng(SEED)
        share = np.bincount(grades, minlength=len(self.gaps) + 2)
        cost = np.sqrt(len(grades) / np.maximum(share, 1) / (share > 0).sum())[grades]
        edges = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
        slots, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        used, slots = np.unique(slots, return_inverse=True)
        p = np.zeros(len(used) + 1 + len(self.gaps))
        m, v, step = np.zeros_like(p), np.zeros_like(p), 0
        batch = 256
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                idx = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in pick])
                owner = np.repeat(np.arange(len(pick)), edges[pick + 1] - edges[pick])
                _, grad = loss_and_gradient(p, len(used), slots[idx], values[idx], owner, grades[pick], cost[pick], decay)
                step += 1
                m = 0.9 * m + 0.1 * grad
                v = 0.999 * v + 0.001 * grad**2
                p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights[used] = p[: len(used)]
        self.first, self.gaps = float(p[len(used)]), p[len(used) + 1 :].copy()
        return self


def loss_and_gradient(p: np.ndarray, used: int, slots: np.ndarray, values: np.ndarray, owner: np.ndarray, grades: np.ndarray, cost: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """The penalised mean negative log-likelihood of some rows and its gradient in p: weights, first threshold, log gaps."""
    n = len(grades)
    w, gaps = p[:used], np.exp(p[used + 1 :])
    cuts = p[used] + np.concatenate([[0.0], np.cumsum(gaps)])
    score = np.bincount(owner, values * w[slots], n)
    inner = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -40, 40)))
    tail = np.concatenate([np.ones((n, 1)), inner, np.zeros((n, 1))], axis=1)
    rows = np.arange(n)
    upper, lower = tail[rows, grades], tail[rows, grades + 1]
    likelihood = np.maximum(upper - lower, 1e-9)
    slope_up, slope_low = upper * (1 - upper), lower * (1 - lower)
    c = cost / n
    d_score = -(slope_up - slope_low) / likelihood * c
    d_cut = np.zeros((n, tail.shape[1]))
    d_cut[rows, grades] += slope_up / likelihood * c
    d_cut[rows, grades + 1] -= slope_low / likelihood * c
    d_cut = d_cut[:, 1:-1].sum(0)
    grad = np.zeros_like(p)
    grad[:used] = np.bincount(slots, values * d_score[owner], used) + decay * w
    grad[used] = d_cut.sum()
    for k, gap in enumerate(gaps):
        grad[used + 1 + k] = d_cut[k + 1 :].sum() * gap
    return float(-(c * np.log(likelihood)).sum() + decay / 2 * (w @ w)), grad


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id, grade from labels (doc_id, quality, toxic)."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def _feature_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        rows = [features(t, hasher) for t in pc.cast(batch.column(1), pa.binary()).to_pylist()]
        yield pa.record_batch(
            [batch.column(0), pa.array([r[0].tolist() for r in rows], pa.list_(pa.int64())), pa.array([r[1].tolist() for r in rows], pa.list_(pa.float64()))], names=["grade", "slots", "values"]
        )


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Ordinal:
    """Fit on about train_rows rated documents, chosen by a hash of doc_id."""
    rated = ratings(labels)
    total = rated.count()
    if not total:
        return Ordinal()
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("grade")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rated.filter(draw < min(1.0, train_rows / total)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("grade", "text")
    table = rows.mapInArrow(_feature_pass, "grade int, slots array<long>, values array<double>").toArrow()
    if not table.num_rows:
        return Ordinal()
    slots, values = (table.column(c).combine_chunks() for c in ("slots", "values"))
    edges, slots, values = slots.offsets.to_numpy(), slots.values.to_numpy(), values.values.to_numpy()
    found = [(slots[lo:hi], values[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    order = sorted(range(len(found)), key=lambda i: (found[i][0].tobytes(), found[i][1].tobytes()))  # whatever order the tasks ended in
    return Ordinal().fit([found[i] for i in order], table.column("grade").to_numpy()[order])


def _score_pass(shared, select_grade: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hasher = shared.value, Hasher()
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for i, text in enumerate(pc.cast(batch.column(1), pa.binary()).to_pylist()):
                slots, values = features(text, hasher)
                score[i] = values @ model.weights[slots]
            tails = model.tails(score)
            yield pa.record_batch(
                [batch.column(0), pa.array(tails.sum(1)), pa.array(tails[:, select_grade - 1]), pa.array(tails[:, select_grade - 1] >= 0.5)], names=["doc_id", "expected_grade", "tail", "selected"]
            )

    return run


def grade(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, select_grade: int = SELECT_GRADE) -> DataFrame:
    """doc_id, expected_grade, tail (P(grade >= select_grade)), selected for every row of docs."""
    model = train(docs, labels, train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_score_pass(shared, select_grade), "doc_id long, expected_grade double, tail double, selected boolean")
