"""The similarity join where stars are cut into tiles, and with rows without doc_id."""

import random

import pytest

from aerolith.llm import jaccard_join


def shingles(text):
    words = (text or "").lower().split()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def components(rows):
    """By row number: the smallest doc_id that links reach."""
    sets, low = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low[find(a)] = find(b)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    return [min((d for d in ids[find(i)] if d is not None), default=None) for i in range(len(rows))]


def variants(rng, words, base, n, most):
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, most)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("tile", [8, 256])
def test_tiles_lose_no_link(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", tile)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for size, n, most in ((60, 90, 5), (120, 60, 9), (30, 40, 3)):  # many too far from the text that they come from
        texts += variants(rng, words, rng.choices(words, k=size), n, most)
    rows = list(enumerate(texts))
    want = components(rows)
    assert 20 < len(set(want)) < len(rows) - 60
    found = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(want))


def test_rows_without_doc_id(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(500)]
    middle = rng.choices(words, k=120)
    left, right = list(middle), list(middle)
    left[10], left[40] = "x1", "x2"
    right[70], right[100] = "y1", "y2"
    other = rng.choices(words, k=50)
    rows = [(1, " ".join(left)), (3, " ".join(right)), (None, " ".join(middle)), (None, " ".join(other)), (7, "alone in the world of words here"), (7, " ".join(other)), (None, "nobody else has it at all"), (None, None), (None, " ".join(left))]
    assert components(rows)[:3] == [1, 1, 1]
    assert components([rows[0], rows[1]]) == [1, 3]
    found = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=key)
    assert got == sorted(((d, len(shingles(t)), c) for (d, t), c in zip(rows, components(rows), strict=True)), key=key)


def test_repeated_rows_and_clashing_columns(spark):
    text = "one two three four five six seven"
    rows = [(5, text, 1), (5, text, 2), (2, text + " eight", 3), (2, text.upper() + " EIGHT", 4), (9, text, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, drop int").withColumnsRenamed({"drop": "DROP"})
    docs = docs.selectExpr("*", "1 AS key", "1 AS label", "1 AS component_id", "1 AS __drop", "1 AS bucket")
    found = jaccard_join.link_components(docs.repartition(3))
    want = components([(d, t) for d, t, _ in rows])
    assert sorted((r["doc_id"], r["component_id"]) for r in found.collect()) == sorted(zip((d for d, _, _ in rows), want, strict=True))
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["DROP"] for r in kept.collect()) == sorted(n for (d, _, n), c in zip(rows, want, strict=True) if c == d)
