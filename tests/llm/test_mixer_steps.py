"""How the mixer's work is dealt, and that it doesn't change what it gives."""

import numpy as np

from aerolith.llm import lm_scoring, mixer


def _trees(texts):
    keys, n = mixer.added_up([mixer.gram_counts(s, coded) for s, coded, _ in mixer.pieces(texts)])
    few = (keys[:0], n[:0])
    return mixer.Trees((keys % mixer.SYMBOLS**2, n), few, few)


def test_alike_symbols_are_counted_along_their_path_once(monkeypatch):
    texts = [b"a plain text with some words, " * 9 + b"\x07end"]
    trees, walked, ways = _trees(texts), [], mixer._ways
    monkeypatch.setattr(mixer, "_ways", lambda length, code: walked.append(len(length)) or ways(length, code))
    one, many = ([np.zeros(2 << bits, np.uint32) for bits in mixer.TABLE_BITS] for _ in range(2))
    mixer.slot_counts(texts, trees, one)
    first = list(walked)
    mixer.slot_counts(texts * 50, trees, many)
    assert walked == first * 2
    assert all((50 * a == b).all() and a.any() for a, b in zip(one, many, strict=True))


def test_scores_depend_on_no_sizes_of_parts(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [rng.choice([b"", b"so ", b"the same words again ", bytes(rng.integers(97, 123, 300).astype(np.uint8))], rng.integers(1, 60)).tolist() for _ in range(40)]
    texts = [b"".join(t) for t in texts]
    trees = _trees(texts)
    tables = [np.zeros(2 << bits, np.uint32) for bits in mixer.TABLE_BITS]
    mixer.slot_counts(texts[::2], trees, tables)
    model = mixer.Mixer(trees, [mixer.log_odds(t[0::2].astype(float), t[1::2].astype(float)) for t in tables])
    whole = model.score(texts)
    monkeypatch.setattr(mixer, "PART", 500)
    monkeypatch.setattr(mixer, "TILE", 3000)
    assert np.allclose(model.score(texts), whole, rtol=0, atol=1e-6 * np.abs(whole))
    assert np.allclose([model.score([t])[0] for t in texts], whole, rtol=0, atol=1e-6 * np.abs(whole))


def _model(texts):
    trees = _trees(texts)
    tables = [np.zeros(2 << bits, np.uint32) for bits in mixer.TABLE_BITS]
    mixer.slot_counts(texts, trees, tables)
    return mixer.Mixer(trees, [mixer.log_odds(t[0::2].astype(float), t[1::2].astype(float)) for t in tables])


def test_hundreds_of_texts_advance_together(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [bytes(rng.choice([97, 98, 99, 100, 32], 3000).astype(np.uint8)) for _ in range(200)]
    model, blocks, block = _model(texts[:20]), [], mixer.Mixer._block
    monkeypatch.setattr(mixer.Mixer, "_block", lambda self, columns, *rest: blocks.append(columns.shape[1]) or block(self, columns, *rest))
    whole = model.score(texts)
    assert max(blocks) <= mixer.TILE and sum(blocks) / len(blocks) > mixer.TILE / 2
    assert np.allclose([model.score([t])[0] for t in texts[::20]], whole[::20], rtol=1e-6, atol=0)


def test_alike_texts_are_scored_once(monkeypatch):
    texts = [b"Some words that come again. " * 8, b"", b"other words"]
    model, seen, inputs = _model(texts), [], mixer.Mixer._inputs
    monkeypatch.setattr(mixer.Mixer, "_inputs", lambda self, bits, *rest: seen.append(len(bits.at)) or inputs(self, bits, *rest))
    once = model.score(texts)
    many = model.score([*texts, texts[0].upper(), *texts[::-1], b""])
    assert seen[0] == seen[1] and len(seen) == 2
    assert (many == once[[0, 1, 2, 0, 2, 1, 0, 1]]).all()


def test_a_text_in_pieces_starts_groups_of_its_own_with_others_beside_it(monkeypatch):
    monkeypatch.setattr(mixer, "CHUNK", 1000)
    rng = np.random.default_rng(5)
    texts = [bytes(rng.choice([97, 98, 99, 32], n).astype(np.uint8)) for n in (10, 3500, 0, 991, 992, 993, 20, 7000, 7, 1001)]
    model = _model(texts)
    whole = model.score(texts)
    alone = np.array([model.score([t])[0] for t in texts])
    assert np.allclose(whole, alone, rtol=1e-6, atol=0)
    monkeypatch.setattr(mixer, "GROUP", 1500)
    assert np.allclose(model.score(texts), alone, rtol=1e-6, atol=0)


def test_words_are_numbered_as_they_come():
    texts = [b"", b" ", b"\tB b\x0b\x0cA\r\n", b"\x1c a\x85 \xc2\xa0 \xff\xfe", b"one  two", "É é a".encode()]
    numbers, lengths, words = lm_scoring._numbered(texts)
    plain = [t.lower().split() for t in texts]
    assert lengths.tolist() == [len(p) for p in plain]
    assert words == list(dict.fromkeys(w for p in plain for w in p))
    assert [words[n] for n in numbers] == [w for p in plain for w in p]
    assert [len(x) for x in lm_scoring._numbered([b"", b"\n"])] == [0, 2, 0]
