"""Toxicity, collocations and hard negatives against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from aerolith.llm import collocations, hard_negatives, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_collocations(rows, threshold, top):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for m in range(1, 6):
                count[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = set()
    for lang, f in count.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= threshold}
        ranked = []
        for p, a in some.items():
            if any(len(o) > len(p) and b >= a and any(o[i : i + len(p)] == p for i in range(len(o))) for o, b in some.items()):
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top]):
            out.add((lang, i + 1, phrase.decode(), -a, left, right, total[lang], -score))
    return out


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    words = ["the", "of", "New", "YORK", "city", "a", "a", "é", "stone", "\x00", "ﬁn"]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(120)]
    rows += [(None, None), ("", "en"), (" \t\r\n .;", "fr"), ("new york city hall " * 30, "en"), ("x " * 500, "fr")]
    return rows + rows[:10]


def test_collocations(spark, prose):
    docs = spark.createDataFrame([(i % 7, t, lang, None, 1) for i, (t, lang) in enumerate(prose)], DOCS)
    for threshold, top in ((20, 2000), (35, 4)):
        found = [tuple(r) for r in collocations.mine(docs.selectExpr("*", "1 AS phrase", "2 AS part", "3 AS n"), threshold, top).collect()]
        assert len(found) == len(set(found))
        assert set(found) == plain_collocations(prose, threshold, top)
    assert collocations.mine(docs.limit(0)).collect() == []


def test_small_blocks_and_bites_count_the_same(prose):
    def counted(size, bite):
        out = Counter()
        batch = pa.record_batch([pa.array([lang or "und" for _, lang in prose]), pa.array([t for t, _ in prose])], names=["lang", "text"])
        for block in collocations.blocks(iter([batch]), size, bite):
            for m in range(1, 6):
                langs, phrases, n = block.phrases(block.starts(m), m)
                for key in zip(langs, phrases, n.tolist(), strict=True):
                    out[key[:2] + (m,)] += key[2]
        return out

    whole = counted(1 << 20, 1 << 22)
    assert whole["en", b"new york city hall new", 5] == 29 + sum(1 for t, _ in prose[-10:] if t and "hall" in t)
    for size, bite in ((1, 1), (7, 3), (50, 11), (3, 1 << 22)):
        assert counted(size, bite) == whole


def test_words_start_anew_within_a_text(prose, monkeypatch):
    monkeypatch.setattr(collocations, "VOCABULARY", 3)
    test_small_blocks_and_bites_count_the_same(prose)


def test_merged_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(3)
    for threshold in (5, 40):
        drawn = (rng.zipf(1.3, 20_000) % 3000).astype(np.uint64)
        exact = Counter(drawn.tolist())
        payload = []
        for some in np.array_split(drawn, 37):
            keys, n = np.unique(some, return_counts=True)
            payload.append(keys.tobytes() + n.astype(np.uint32).tobytes())
        kept = set(collocations._merge_group(threshold)(pa.table({"summary": pa.array(payload, pa.binary())})).column("key").to_numpy().view(np.uint64).tolist())
        assert {k for k, n in exact.items() if n >= threshold} <= kept
        assert len(kept) <= len(drawn) // threshold + 1
        summary, lost = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0
        for some in np.array_split(drawn, 50):  # with few counters: each loses what the bound allows at most
            keys, n = np.unique(some, return_counts=True)
            summary, less = collocations.merge(summary, keys, n, len(drawn) // threshold + 1)
            lost += less
        assert lost < threshold
        assert all(exact[k] - lost <= n <= exact[k] for k, n in zip(summary[0].tolist(), summary[1].tolist(), strict=True))


def test_a_full_bitmap_changes_no_result(spark, prose, monkeypatch):
    whole = collocations.bitmap
    monkeypatch.setattr(collocations, "bitmap", lambda keys, max_bits=6: whole(keys, 6))
    docs = spark.createDataFrame([(i, t, lang, None, 1) for i, (t, lang) in enumerate(prose)], DOCS)
    assert {tuple(r) for r in collocations.mine(docs, 20).collect()} == plain_collocations(prose, 20, 2000)


def plain_negatives(rows):
    kept = []
    for vec_id, v, label in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = Counter()
    for i, (anchor, label, v) in enumerate(kept):
        if anchor % 100:
            continue
        scores = [(-sum(a * b for a, b in zip(v, o[2], strict=False)), o[0], o[1]) for j, o in enumerate(kept) if j != i]
        for s, p, _ in sorted(x for x in scores if x[2] == label)[:5]:
            some = sorted((n, q) for n, q, la in scores if la != label and -80 * s <= -100 * n <= -100 * s)[:5]
            out.update((anchor, p, k + 1, q, -s, -n) for k, (n, q) in enumerate(some))
    return out


EMBEDDINGS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("dims", [1, 2, 5, 24])
def test_hard_negatives(spark, dims):
    rng = np.random.default_rng(dims)
    rows = [(int(i) if i % 5 else int(i) * 4, [float(np.float32(x)) for x in rng.normal(size=dims) * rng.choice([0.1, 1, 1, 3])], int(rng.integers(0, 4))) for i in range(700)]
    rows += [(100, rows[100][1], 1), (100, rows[100][1], 1), (200, [], 1), (300, [1.0] * (dims + 2), 2), (301, [0.0] * dims, 2), (400, [0.0] * dims, 2)]
    rows += [(500, None, 1), (600, [float("nan")] * dims, 1), (700, [None] * dims, 1), (800, [1.0] * dims, None), (None, [1.0] * dims, 1), (801, [float("inf")] * dims, 1)]
    rows += [(900 + i, [0.25] * dims, i % 3) for i in range(150)]
    table = spark.createDataFrame(rows, EMBEDDINGS).selectExpr("*", "1 AS size", "2 AS v", "3 AS block", "4 AS deal")
    for block, anchors in ((4096, 4096), (64, 3)):
        found = hard_negatives.mine(table.repartition(3), block=block, anchor_block=anchors)
        assert Counter(tuple(r) for r in found.collect()) == plain_negatives(rows)
    assert hard_negatives.mine(table.limit(0)).collect() == []


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[2.0**40, 1.0], [1e300, 0.0]]), np.array([[2.0**20, 1.0], [1e300, -1.0]])
    assert hard_negatives.inner_products(a, b).tolist() == [[2**60 + 1, 1 << 62], [1 << 62, 1 << 62]]


def test_coordinate_ranges_prune_and_lose_nothing():
    rng = np.random.default_rng(1)
    pruned = 0
    for dims in (2, 3, 8):
        v = np.round(rng.normal(size=(300, dims)) * 200)
        bucket = hard_negatives.Bucket(np.arange(300), np.zeros(300, np.int64), v)
        for a in np.round(rng.normal(size=(60, dims)) * 200):
            scores, size = v @ a, float(np.sqrt(a @ a))
            focus = np.argsort(-np.abs(a))[: hard_negatives.FOCUS]
            for share in (0.3, 0.8, 0.95, 1.0):
                least = math.ceil(share * scores.max())
                rows = bucket.candidates(a / size, focus, size, least)
                if rows is not None:
                    assert set(np.flatnonzero(scores >= least)) <= set(rows.tolist())
                    pruned += 300 - len(rows)
    assert pruned > 216_000 / 3


def toxic_rows(n, seed=2):
    rng = random.Random(seed)
    words = ["the", "river", "runs", "over", "stones", "and", "you", "see", "old", "houses"]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for w in rng.choice([["idiot"], ["1d10t"], ["MORON!!!"], ["s", "c", "u", "m"], ["vequ" + rng.choice("abcdefgh") * 2, "vequ" + rng.choice("abcdefgh") * 3]]):
                text.insert(rng.randrange(len(text)) if len(w) > 1 else len(text), w)
        rows.append((i, " ".join(text), "en", None, 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_of_rows_never_learned_from(spark):
    rows, labels = toxic_rows(1500)
    rows += [(5000, None, "en", None, 0), (5001, "", "en", None, 0), (None, "you idiot", "en", None, 0), (None, "the river", "en", None, 0), (7, "you idiot", "en", None, 0), (5002, "word " * 300_000 + "idiot", "en", None, 0)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS fold", "2 AS toxic", "3 AS term")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (8, 1, 7)], LABELS)
    found = toxicity.score(docs, marks).collect()
    assert len(found) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    truth = {i: t for i, _, t in labels}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 300
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    again = toxicity.score(docs.repartition(5), marks.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot", "en", None, 1), (2, None, None, None, None)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {(r["doc_id"], r["score"], r["predicted"]) for r in toxicity.score(docs, none).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
    one_kind = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], LABELS)
    assert {r["score"] for r in toxicity.score(docs, one_kind).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), one_kind).collect() == []


def test_a_labelled_document_that_repeats_is_learned_once(spark):
    rows, labels = toxic_rows(60)
    docs = spark.createDataFrame(rows, DOCS).unionByName(spark.range(20_000).selectExpr("7L AS doc_id", "repeat('again and again ', 20) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars"))
    assert toxicity.labelled(docs, spark.createDataFrame(labels, LABELS)).count() == 60


def test_features_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(4)
    words = ["idiot", "you", "river", "stone", "a", "b!", "MORON", "it", "was", "old", "so", "then"]
    texts = [" ".join(rng.choices(words, weights=[1, 1, 9, 9, 1, 1, 1, 9, 9, 9, 9, 9], k=400)) for _ in range(20)]
    lexicon = toxicity.Lexicon({"stone": 2.0, "rive*": 0.5, "old": -1.0})
    whole = [toxicity.features(t, lexicon) for t in texts]
    n = 2 * (toxicity.PER_WORD - 1 + 5)
    for t, x in zip(texts, whole, strict=True):
        w = t.split()
        term = [v in ("idiot", "MORON", "stone", "river") for v in w]
        assert x[n + 3] == sum(any(w[j] == "you" for j in range(max(0, i - 5), min(len(w), i + 6))) for i in range(len(w)) if term[i])
    monkeypatch.setattr(toxicity, "SLICE", 16)
    for t, x in zip(texts, whole, strict=True):
        assert np.allclose(np.delete(toxicity.features(t, lexicon), n + 4), np.delete(x, n + 4))  # letters spelled over a border aside


def test_isotonic_map_is_the_best_non_decreasing_one():
    rng = np.random.default_rng(0)
    score = rng.integers(0, 30, 200).astype(float)
    y = (rng.random(200) < score / 30).astype(float)
    mapped = toxicity.Isotonic().fit(score, y).map(score)
    order = np.argsort(score, kind="stable")
    assert (np.diff(mapped[order]) >= -1e-12).all()
    values = np.unique(score)
    mean, weight = np.array([y[score == v].mean() for v in values]), np.array([(score == v).sum() for v in values])
    for i, v in enumerate(values):  # the max-min formula
        best = max(min((mean[a : b + 1] * weight[a : b + 1]).sum() / weight[a : b + 1].sum() for b in range(i, len(values))) for a in range(i + 1))
        assert abs(best - mapped[score == v][0]) < 1e-9


def test_trees_find_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.3)).astype(float)
    raw = toxicity.Trees().fit(x[:1500], y[:1500]).raw(x[1500:])
    assert ((raw > 0) == y[1500:]).mean() > 0.97
    constant = toxicity.Trees().fit(np.zeros((50, 3)), (np.arange(50) % 2).astype(float))
    assert np.allclose(constant.raw(np.zeros((3, 3))), 0.0, atol=1e-6)
