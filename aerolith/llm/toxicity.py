"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of the whole text, as counts and as densities over its words:

* lexicons: ``INSULTS`` below (a list by hand), and terms that the labelled rows set apart:
  words, and beginnings of 4 to 7 letters, each weighed by its log-odds;
* the same after obfuscation is undone: digits and signs in place of letters, letters
  repeated or spelled one by one;
* second-person words, and terms within ``NEAR`` words of one;
* (ASCII) capitals, exclamation and question marks, other signs, words with signs or digits
  inside, repeated letters.

``TREES`` trees of depth ``DEPTH`` are fitted to the logistic loss on histograms. The terms of a
row's lexicon never come from its own fold, neither do the scores on which the isotonic map
(pool adjacent violators) is fitted, so that both are honest.

Bounds: about ``train_rows`` labelled documents, chosen by a hash of doc_id, one row of
each; their features (not their texts) and the ``MAX_TERMS`` most telling terms reach the driver.
Every row is scored.

Defined cases: null and empty texts have all features 0 and get the score of such a row;
labels other than 0 and 1 are left out; a document labelled more than once counts as toxic if any of
its labels says so, and is learned from the last of its texts in byte order; without labels of both kinds every score is 0;
repeated rows and rows without doc_id each give their row (a null doc_id hashes as an empty text); a text of any
length is read whole; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm import common
from aerolith.llm.language_id import fold

TRAIN_ROWS = 20_000
MAX_TERMS = 20_000
FOLDS = 3
TREES = 80
DEPTH = 4
BINS = 64
RATE = 0.15
THRESHOLD = 0.3
NEAR = 5
BEGINNINGS = (4, 5, 6, 7)
#: A term is told apart from chance by this likelihood ratio (G squared) and this many toxic documents.
TELLING = 20.0
LEAST_TOXIC = 3
CACHE = 300_000
#: Words of a text that are looked at together.
SLICE = 1 << 18

#: Words of abuse in four languages.
INSULTS = frozenset(
    """
    arse arsehole ass asshole bastard bitch bollocks bullshit clown coward creep crap cretin degenerate
    dickhead dimwit disgusting dumb dumbass dunce fool freak fuck fucked fucker fucking garbage halfwit hypocrite idiot
    idiotic idiots ignorant imbecile jackass jerk lame liar loser losers lowlife lunatic maggot moron moronic
    morons motherfucker nitwit parasite pathetic pervert pig prick psycho repulsive retard rubbish scum
    scumbag shit shithead shitty shut sicko simpleton skank slut stupid stupidity suck sucks swine thug
    trash troll twat twit ugly vermin vile wanker weirdo whore wimp worthless wretch
    abschaum arschloch blödmann depp dumm dummkopf dreck dreckig esel ekelhaft hurensohn idioten mistkerl scheisse
    scheiße schlampe schwachkopf schwein trottel verlierer versager vollidiot wertlos widerlich
    abruti batard bâtard bouffon conard connard connasse con débile dégueulasse idiote imbécile merde minable
    nul ordure pourriture putain raclure salaud salope sot stupide taré
    asqueroso basura bobo cabrón capullo cerdo cretino escoria estúpido estupido gilipollas idiota imbécil inútil inutil
    maldito mierda mugroso pendejo perdedor patético patetico puta puto tarado tonto zorra
    """.split()
)
#: Words that address someone.
ADDRESS = frozenset(
    """
    you your yours yourself yourselves u ur ya ye thee thou
    du dich dir dein deine deinen deiner deines ihr euch euer eure
    tu toi te ton ta tes vous votre vos
    tú ti tus usted ustedes vosotros vuestro vuestra
    """.split()
)
#: Signs that stand for letters.
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"})

_MARKS = re.compile(r"[^\w]+", re.UNICODE)
_INSIDE = re.compile(r"\w[^\w\s'’-]+\w|[^\W\d_]\d+[^\W\d_]", re.UNICODE)
_REPEAT = re.compile(r"(.)\1{2,}")
_EDGE = ".,;:!?\"'()[]{}«»“”„’…-–—" + "#*$%&@|<>~^=_+"
_BYTES = {kind: np.array([c for c in range(256) if test(c)]) for kind, test in {
    "capitals": lambda c: 65 <= c <= 90,
    "letters": lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC2,  # or the first byte of a character beyond ASCII
    "!": lambda c: c == 33,
    "?": lambda c: c == 63,
    "signs": lambda c: chr(c) in "#*$%&@|<>~^=_",
}.items()}

#: What a word adds: insult, disguised insult, toxic log-odds of the word, of its beginnings, clean log-odds, term, addresses, all capitals, obfuscated, repeated letters, one letter.
PER_WORD = 11
TERM, ADDRESSES, SINGLE = 5, 6, 10
#: Counts and densities of these (but the last) and of the kinds of bytes, then: strongest word, strongest beginning, different terms, terms near an address, spelled insults, length.
FEATURES = 2 * (PER_WORD - 1 + len(_BYTES)) + 6


def core(word: str) -> str:
    """The letters and digits of a word, lower-cased, without signs around or inside."""
    return _MARKS.sub("", word).replace("_", "").lower()


def plain(word: str) -> str:
    """A word with signs read as letters and no letter three times in a row."""
    return _REPEAT.sub(r"\1", core(word.lower().rstrip("!?.,").translate(_PLAIN)))


def terms(word: str) -> list[str]:
    """What the learned lexicon may hold of a word: itself, and its beginnings (marked by a star)."""
    low = core(word)
    return [low, *(low[:n] + "*" for n in BEGINNINGS if len(low) > n)] if len(low) > 1 else []


class Lexicon(dict):
    """Word -> number of what it adds to the features, which many words share; bounded, as it starts anew when full."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights
        self.restart(0)

    def restart(self, most: int = CACHE) -> None:
        if len(self) >= most:
            self.clear()
            self.numbers: dict[tuple, int] = {}
            self.rows: list[tuple] = []
            self.words: list[str | None] = []

    def __missing__(self, word: str) -> int:
        bare = word.strip(_EDGE)
        alpha = bare.isalpha()
        low = bare.lower() if alpha else core(word)
        repeats = _REPEAT.search(low) is not None
        own = starts = 0.0
        size = len(low)
        if size > 1:
            get = self.weights.get
            own = get(low, 0.0)
            for n in BEGINNINGS:
                if size > n:
                    starts = max(starts, get(low[:n] + "*", 0.0))
        insult = low in INSULTS
        hidden = not insult and (repeats or not alpha) and (even := plain(word)) != low and even in INSULTS
        term = insult or hidden or own > 0 or starts > 0
        row = (insult, hidden, max(own, 0.0), starts, -min(own, 0.0), term, low in ADDRESS, size > 2 and bare.isupper(), not alpha and _INSIDE.search(word) is not None, repeats, size == 1)
        key = (row, low if term else None)
        at = self.numbers.get(key)
        if at is None:
            at = self.numbers[key] = len(self.rows)
            self.rows.append(row)
            self.words.append(low if term else None)
        self[word] = at
        return at


def _spelled(letters: str) -> int:
    return sum(letters[i:j] in INSULTS for i in range(len(letters)) for j in range(i + 3, min(len(letters), i + 14) + 1))


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """The features of a text, read in slices of words."""
    out = np.zeros(FEATURES)
    words = (text or "").split()
    if not words:
        return out
    total, strongest, found, near, spelled = np.zeros(PER_WORD), np.zeros(2), set(), 0, 0
    before = np.zeros((0, 2), bool)  # term, address of the last words of the slice before
    for at in range(0, len(words), SLICE):
        lexicon.restart()
        some = words[at : at + SLICE]
        numbers = np.array([lexicon[w] for w in some])
        counts = np.bincount(numbers)
        kinds = np.flatnonzero(counts)
        rows = np.array([lexicon.rows[k] for k in kinds.tolist()], float)
        total += counts[kinds] @ rows
        strongest = np.maximum(strongest, rows[:, 2:4].max(0))
        found.update(lexicon.words[k] for k in kinds[rows[:, TERM] > 0].tolist())
        flags = np.zeros((len(counts), 3), bool)
        flags[kinds] = rows[:, [TERM, ADDRESSES, SINGLE]] > 0
        marks = np.concatenate([before, flags[numbers][:, :2]])
        if marks.any(0).all():
            near += _near(marks, len(before))
        before = marks[-2 * NEAR :]
        if rows[:, SINGLE] @ counts[kinds] > 2:
            single = np.concatenate([[False], flags[numbers][:, 2], [False]])
            edges = np.flatnonzero(single[1:] != single[:-1])
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a > 2:
                    spelled += _spelled("".join(core(w) for w in some[a:b]))
    bytes_ = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    counted = np.concatenate([total[:SINGLE], [bytes_[kind].sum() for kind in _BYTES.values()]])
    n = len(counted)
    out[:n] = np.log1p(counted)
    out[n : 2 * n] = counted / len(words)
    out[2 * n :] = [*strongest, len(found), near, spelled, np.log1p(len(words))]
    return out


def _near(marks: np.ndarray, new: int) -> int:
    """Terms with an address within NEAR words; of those among the first new marks only ones that the slice before could not see."""
    address = np.concatenate([[0], np.cumsum(marks[:, 1])])
    places = np.flatnonzero(marks[:, 0])

    def seen(end: int) -> np.ndarray:
        return address[np.clip(places + NEAR + 1, 0, end)] - address[np.clip(places - NEAR, 0, end)] > 0

    return int((seen(len(marks)) & ~((places < new) & ((places < new - NEAR) | seen(new)))).sum())


class Trees:
    """Gradient-boosted regression trees for the logistic loss, grown level by level on histograms."""

    def __init__(self) -> None:
        self.base, self.edges, self.trees = 0.0, [], []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, penalty: float = 1.0, least: float = 1.0) -> Trees:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="higher")) for column in x.T]
        # most columns are 0 nearly everywhere: quantiles of what isn't give them edges as well
        self.edges = [np.unique(np.concatenate([e, np.quantile(c[c > 0], np.linspace(0, 1, 9), method="higher")])) if (c > 0).any() else e for e, c in zip(self.edges, x.T, strict=True)]
        bins = self.binned(x)
        width = max(len(e) for e in self.edges) + 1
        flat = bins + width * np.arange(bins.shape[1])
        score = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            features_, cuts = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, width, np.int64)
            for level in range(depth):
                first, n = 2**level - 1, 2**level
                size = n * width * bins.shape[1]
                slot = (node[:, None] * (width * bins.shape[1]) + flat).ravel()
                sums = [np.bincount(slot, np.repeat(v, bins.shape[1]), size).reshape(n, bins.shape[1], width).cumsum(2) for v in (g, h)]
                whole_g, whole_h = sums[0][:, :, -1:], sums[1][:, :, -1:]
                left_g, left_h = sums
                gain = left_g**2 / (left_h + penalty) + (whole_g - left_g) ** 2 / (whole_h - left_h + penalty) - whole_g**2 / (whole_h + penalty)
                gain = np.where((left_h >= least) & (whole_h - left_h >= least), gain, 0.0).reshape(n, -1)
                best = gain.argmax(1)
                split = gain[np.arange(n), best] > 1e-9
                features_[first : first + n] = np.where(split, best // width, 0)
                cuts[first : first + n] = np.where(split, best % width, width)
                node = 2 * node + (bins[np.arange(len(y)), features_[first + node]] > cuts[first + node])
            leaves = 2**depth
            values = rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + penalty)
            self.trees.append((features_, cuts, values))
            score += values[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        bins, rows = self.binned(x), np.arange(len(x))
        for features_, cuts, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(int(np.log2(len(values)))):
                at = 2**level - 1 + node
                node = 2 * node + (bins[rows, features_[at]] > cuts[at])
            score += values[node]
        return score


class Isotonic:
    """The non-decreasing map from scores to shares that fits best, by pooling adjacent violators."""

    def __init__(self) -> None:
        self.at, self.share = np.zeros(1), np.zeros(1)

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        values, inverse = np.unique(score, return_inverse=True)
        weight = np.bincount(inverse).astype(float)
        mean = np.bincount(inverse, y) / weight
        pools: list[list[float]] = []  # share, weight, first and last score
        for m, w, v in zip(mean, weight, values, strict=True):
            pools.append([m, w, v, v])
            while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
                m2, w2, _, last = pools.pop()
                m1, w1, first, _ = pools.pop()
                pools.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last])
        self.at = np.array([x for p in pools for x in (p[2], p[3])])
        self.share = np.array([x for p in pools for x in (p[0], p[0])])
        return self

    def map(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.share)


class Model:
    def __init__(self, weights: dict[str, float], trees: Trees | None = None, isotonic: Isotonic | None = None):
        self.weights, self.trees, self.isotonic = weights, trees, isotonic

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.isotonic.map(self.trees.raw(x)), 0.0, 1.0) if self.trees else np.zeros(len(x))


def _texts(column: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in pc.cast(column, pa.binary()).to_pylist()]


def _term_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, fold, toxic, n: in how many documents of a batch it stands."""
    for batch in batches:
        count: Counter = Counter()
        for part, toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2)), strict=True):
            count.update((t, part, toxic) for t in {t for w in set(text.split()) for t in terms(w)})
        keys = list(zip(*count, strict=True)) or [(), (), ()]
        yield pa.record_batch([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.int32()), pa.array(list(count.values()), pa.int64())], names=["term", "fold", "toxic", "n"])


def _log_odds(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> np.ndarray:
    """Log-odds of terms by their numbers of toxic and clean documents; 0 where it may be chance."""
    share = (toxic + clean) / max(all_toxic + all_clean, 1)

    def part(n: np.ndarray, whole: float, s: np.ndarray) -> np.ndarray:
        return n * np.log(np.maximum(n, 1e-9) / np.maximum(whole * s, 1e-9))

    g = 2 * (part(toxic, all_toxic, share) + part(clean, all_clean, share) + part(all_toxic - toxic, all_toxic, 1 - share) + part(all_clean - clean, all_clean, 1 - share))
    odds = np.log((toxic + 0.5) / (all_toxic + 1)) - np.log((clean + 0.5) / (all_clean + 1))
    return np.where((g >= TELLING) & ((toxic >= LEAST_TOXIC) | (odds < 0)), odds, 0.0)


def _feature_pass(shared):
    """toxic, fold and the features of a labelled text under the lexicon without its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [Lexicon(w) for w in shared.value]
        for batch in batches:
            x = np.array([features(t, lexicons[k]) for k, t in zip(batch.column(0).to_pylist(), _texts(batch.column(2)), strict=True)]).reshape(-1, FEATURES)
            yield pa.record_batch([batch.column(1), batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], names=["toxic", "fold", "x"])

    return run


def labelled(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """fold, toxic, text of about train_rows labelled documents, one row of each."""
    rated = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = rated.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxic")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rated.filter(draw < min(1.0, train_rows / max(total, 1))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(FOLDS)).cast("int")
    return rows.select(part.alias("fold"), "toxic", "text")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model fitted to the labels of docs; docs and labels must hold no row that isn't to be learned from."""
    rows = common.spill(labelled(docs, labels, train_rows), "labelled")[0]
    size = np.zeros((FOLDS, 2))
    for r in rows.groupBy("fold", "toxic").count().collect():
        size[r["fold"], r["toxic"]] = r["count"]
    if not size.sum(0).all():
        return Model({})
    of = [F.coalesce(F.sum(F.when((F.col("fold") == k) & (F.col("toxic") == t), F.col("n"))), F.lit(0)) for k in range(FOLDS) for t in (0, 1)]
    counts = rows.mapInArrow(_term_pass, "term string, fold int, toxic int, n long").groupBy("term").agg(F.array(*of).alias("n"))
    toxic, clean = (sum(F.col("n")[2 * k + t] for k in range(FOLDS)) for t in (1, 0))
    leaning = F.abs(F.log((toxic + 0.5) / float(size[:, 1].sum() + 1)) - F.log((clean + 0.5) / float(size[:, 0].sum() + 1)))
    kept = counts.filter(toxic + clean >= LEAST_TOXIC).withColumn("weight", leaning * F.sqrt(toxic + clean)).orderBy(F.desc("weight"), "term").limit(MAX_TERMS).select("term", "n").toArrow()
    names = kept.column("term").to_pylist()
    n = np.array(kept.column("n").to_pylist(), float).reshape(-1, FOLDS, 2)
    weights = []
    for k in range(FOLDS + 1):  # without fold k; the last one with all
        some = [j for j in range(FOLDS) if j != k]
        odds = _log_odds(n[:, some, 1].sum(1), n[:, some, 0].sum(1), *size[some].sum(0)[::-1])
        weights.append({t: float(o) for t, o in zip(names, odds, strict=True) if o})
    shared = docs.sparkSession.sparkContext.broadcast(weights[:FOLDS])
    table = rows.mapInArrow(_feature_pass(shared), "toxic int, fold int, x array<double>").toArrow()
    x, y, part = np.array(table.column("x").to_pylist()).reshape(-1, FEATURES), table.column("toxic").to_numpy().astype(float), table.column("fold").to_numpy()
    order = np.lexsort((*x.T, y, part))  # whatever order the tasks ended in
    x, y, part = x[order], y[order], part[order]
    honest = np.zeros(len(y))
    for k in range(FOLDS):
        if len(set(y[part != k])) > 1:
            honest[part == k] = Trees().fit(x[part != k], y[part != k]).raw(x[part == k])
    return Model(weights[FOLDS], Trees().fit(x, y), Isotonic().fit(honest, y))


def _score_pass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lexicon = Lexicon(model.weights)
        for batch in batches:
            x = np.array([features(t, lexicon) for t in _texts(batch.column(2))]).reshape(-1, FEATURES)
            score = model.scores(x)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, written; rows of the held-out fold are never learned from."""
    out = fold(F.col("doc_id"), folds) == held_out
    with common.batch_rows(docs.sparkSession, 1000), common.workspace(docs.sparkSession) as result:
        shared = docs.sparkSession.sparkContext.broadcast(train(docs.filter(~out), labels.filter(~out), train_rows))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text")
        return result(rows.mapInArrow(_score_pass(shared), "doc_id long, held_out boolean, score double, predicted int"), "toxicity")
