"""Signatures of subsets: linked sets share one, unrelated short texts share none; heavy classes."""

import collections
import random

import numpy as np
import pytest

from aerolith.llm import jaccard_join


def _set(members):
    return np.unique(jaccard_join._mix(np.array(sorted(members), np.uint64)))


@pytest.mark.parametrize("n", range(5, 31))
def test_unrelated_texts_share_no_bucket(n):
    rng, words = random.Random(n), jaccard_join._Words()
    none = np.zeros(0, np.uint64)
    held = collections.Counter()
    for _ in range(8_000):
        text = " ".join(f"w{rng.randrange(50_000)}" for _ in range(n))
        held.update(jaccard_join.signatures(jaccard_join.shingles(text.encode(), words), none).tolist())
    assert not held or max(held.values()) <= 8


@pytest.mark.parametrize("common_share", [0, 0.4, 1])
def test_linked_sets_share_a_signature(common_share):
    """All that differs, and by as much as links allow, from the smallest sets on."""
    rng = random.Random(7)
    for size in [*range(3, 70), 127, 128, 200, 255, 256, 400]:
        for _ in range(12):
            base = rng.sample(range(1 << 40), size)
            same = rng.randint(-(-3 * size // 4), size)
            other = base[:same]
            most = same * 100 // 75 - size  # union * 75 <= same * 100
            other += [(1 << 41) + rng.randrange(1 << 40) for _ in range(rng.choice([0, max(0, most)]))]
            a, b = _set(base), _set(other)
            common = np.sort(np.array(rng.sample([*set(a) | set(b)], int(common_share * len(set(a) | set(b)))), np.uint64))
            if jaccard_join.linked(a, b) and len(jaccard_join.without(a, b)) + len(jaccard_join.without(b, a)):
                assert np.intersect1d(jaccard_join.signatures(a, common), jaccard_join.signatures(b, common)).size, (size, same)


def test_sets_of_one_or_two_shingles_link_to_no_other():
    for n in (1, 2):
        a = _set(range(n))
        for more in (0, 1):
            for gone in range(n + 1):
                b = _set([*range(gone, n), *range(100, 100 + more)])
                assert jaccard_join.linked(a, b) == (len(b) == n and (a == b).all())


@pytest.mark.parametrize("heavy", [2, 1_000])
def test_copies_of_one_text_and_rows_without_words(spark, monkeypatch, heavy):
    """Heavy classes, light ones and rows without words, each with the right component."""
    monkeypatch.setattr(jaccard_join, "HEAVY", heavy)
    rng = random.Random(3)
    base = [f"w{rng.randrange(9000)}" for _ in range(60)]
    near = [*base[:-1], "end"]
    rows = [(i, " ".join(base)) for i in range(50, 110)] + [(7, " ".join(near)), (8, ""), (9, None), (None, " "), (20, "a b c"), (15, "A b C")]
    found = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = dict.fromkeys([7, *range(50, 110)], 7) | {8: 8, 9: 9, None: None, 20: 15, 15: 15}
    assert len(found) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert {r["doc_id"]: r["n_shingles"] for r in found if r["doc_id"] in (8, 9, 20, 50)} == {8: 0, 9: 0, 20: 1, 50: 56}
