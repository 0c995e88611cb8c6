"""The mixing model against a plain loop over bits, and on texts that show what it learns online."""

import math
import random

import numpy as np
import pytest

from aerolith.llm import mixer


def trained(texts, most=mixer.OWN_TREES, least=1):
    keys, n = mixer.added_up([mixer.gram_counts(s, c) for s, c, _ in mixer.pieces(texts)])

    def rows(length, limit):
        k, times = mixer.added_up([(keys % mixer.SYMBOLS ** (length + 1), n)])
        if limit is None:
            return k, times
        _, at = np.unique(k // mixer.SYMBOLS, return_inverse=True)
        weight = np.bincount(at, times)
        own = [c for c in np.argsort(-weight, kind="stable")[:limit] if weight[c] >= least]
        keep = np.isin(at, own)
        return k[keep], times[keep]

    trees = mixer.Trees(rows(1, None), rows(2, most[0]), rows(3, most[1]))
    counts = [np.zeros(2 << b, np.uint32) for b in mixer.TABLE_BITS]
    mixer.slot_counts(texts, trees, counts)
    return mixer.Mixer(trees, [mixer.log_odds(c[0::2].astype(float), c[1::2].astype(float)) for c in counts])


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh é", k=rng.randint(2, 7))) for _ in range(300)]
    return trained([" ".join(rng.choices(words, k=400)).encode() for _ in range(40)], (20, 60), 20)


def plain_tree(model, past):
    t = model.trees
    a, b, c = past[-3:]
    own = t.three[t.row[a * 257 + b] * 257 + c]
    return int(own if own >= 0 else t.two[b * 257 + c])


def plain_path(model, tree, symbol):
    n, code = int(model.trees.length[tree, symbol]), int(model.trees.code[tree, symbol])
    return [code >> (n - 1 - d) & 1 for d in range(n)]


def plain_score(model, text):
    """The natural-log probability of a text, bit by bit."""
    t = model.trees
    symbols = [mixer.END] * mixer.PAD + list(text.lower()) + [mixer.END]
    hashes, _ = mixer._contexts(np.array(symbols, np.int64))
    last = [mixer.START_MATCH if g % 4 else mixer.START_ESCAPE for g in range(mixer.GATES - 1)] + [mixer.START_BRANCH]
    weights = [[mixer.START] * mixer.CONTEXTS + [last[g]] for g in range(mixer.GATES)]
    step = 2 * mixer.LIMIT / (mixer.BUCKETS - 1)
    seen = [mixer.MAP_PRIOR] * mixer.BUCKETS
    ones = [mixer.MAP_PRIOR / (1 + math.exp(-(k - mixer.BUCKETS // 2) * step)) for k in range(mixer.BUCKETS)]
    latest, branches, held, done, total = {}, {}, 0, 0, 0.0
    edges = list(mixer.BLOCKS[1:])
    while edges[-1] < 40 * len(symbols):
        edges.append(edges[-1] + mixer.BLOCKS[-1])
    pending = []
    for i in range(mixer.PAD, len(symbols)):
        tree = plain_tree(model, symbols[:i])
        key = tuple(symbols[i - mixer.MATCH : i])
        guess = latest.get(key)
        latest[key] = symbols[i]
        target = plain_path(model, tree, guess) if guess is not None else None
        escape = [int(t.escape_code[tree]) >> (int(t.escape_length[tree]) - 1 - d) & 1 for d in range(int(t.escape_length[tree]))]
        level = min(len(mixer.TRUST) - 1, held.bit_length())
        path = plain_path(model, tree, symbols[i])
        for d, bit in enumerate(path):
            node = int("1" + "".join(map(str, path[:d])), 2)
            x, known = [], 0
            for h, table, bits in zip(hashes, model.tables, mixer.TABLE_BITS, strict=True):
                odds = int(table[(int(h[i]) + node) & ((1 << bits) - 1)])
                known += odds != mixer.UNSEEN
                x.append(0.0 if odds == mixer.UNSEEN else odds / mixer.SCALE)
            on = target is not None and target[:d] == path[:d] and d < len(target)
            gate = 4 * known + (int(mixer._MATCH_GATE[level + 1]) if on else 0)
            if t.rare[tree, symbols[i]] and d >= len(escape):
                zeros, n1 = branches.get(tuple(path[len(escape) : d]), (0, 0))
                branches[tuple(path[len(escape) : d])] = (zeros + 1 - bit, n1 + bit)
                branch = math.log((n1 + 0.4) / (zeros + 0.4))
            else:
                branch = None
            if on:
                x.append((1 if target[d] else -1) * float(mixer.TRUST[level]))
            elif branch is not None:
                x.append(branch)
                gate = mixer.GATES - 1
            else:
                x.append(mixer.ESCAPING * (1 if escape[d] else -1) if escape[:d] == path[:d] and d < len(escape) else 0.0)
            dot = max(-mixer.LIMIT, min(mixer.LIMIT, sum(w * v for w, v in zip(weights[gate], x, strict=True))))
            p = 1 / (1 + math.exp(-dot))
            cell = int((dot + mixer.LIMIT) / step + 0.5)
            final = (p + ones[cell] / seen[cell]) / 2
            total += math.log(final if bit else 1 - final)
            pending.append((gate, x, bit - p, cell, bit))
            done += 1
            if done == edges[0]:
                edges.pop(0)
                learn(weights, seen, ones, pending)
                pending = []
        held = held + 1 if guess == symbols[i] else 0
        if i == mixer.PAD:
            held = 0
    return total


def learn(weights, seen, ones, pending):
    n = [0] * len(weights)
    slope = [[0.0] * mixer.INPUTS for _ in weights]
    for gate, x, error, cell, bit in pending:
        n[gate] += 1
        seen[cell] += 1
        ones[cell] += bit
        for c, v in enumerate(x):
            slope[gate][c] += error * v
    for gate, row in enumerate(slope):
        for c, v in enumerate(row):
            weights[gate][c] += mixer.RATE / (1 + n[gate] / 24) * v


@pytest.mark.parametrize("text", [b"", b"abc gh", b"abcab " * 300, "hé gab éé fed bad xyz ß".encode() * 20, bytes(range(256)) * 3, b"A" * 2000])
def test_equals_a_plain_loop(model, text):
    assert model.score([text])[0] == pytest.approx(plain_score(model, text), rel=1e-4)


def test_paths_are_a_prefix_code(model):
    t = model.trees
    for tree in range(len(t.length)):
        assert sum(2.0 ** -float(n) for n in t.length[tree]) <= 1 + 1e-12
        assert len({(n, c) for n, c in zip(t.length[tree].tolist(), t.code[tree].tolist(), strict=True)}) == mixer.SYMBOLS


def test_does_not_depend_on_neighbours(model, monkeypatch):
    texts = [b"abc abd " * 20, b"", b"zz", bytes(range(256)) * 4, b"gab fed bad " * 3000, b"hh" * 50]
    together = model.score(texts)
    assert together == pytest.approx([model.score([t])[0] for t in texts], rel=1e-5) and (together < 0).all()
    assert together[::-1] == pytest.approx(model.score(texts[::-1]), rel=1e-5)


def test_a_long_text_goes_on_over_pieces(model, monkeypatch):
    text = bytes(random.Random(2).choices(b"abcdefgh ", k=30_000))
    whole = model.score([text])[0]
    monkeypatch.setattr(mixer, "CHUNK", 4096)
    cut = model.score([b"x", text, b"y"])
    assert cut[1] == pytest.approx(model.score([text])[0], rel=1e-6)
    assert cut[1] == pytest.approx(whole, rel=0.02)


def test_learns_online(model):
    def bits(text):
        return -model.score([text])[0] / math.log(2) / len(text)

    rng = np.random.default_rng(0)
    assert bits(b"q" * 100_000) < 0.1
    assert bits(b"xq zjkw9#p" * 5000) < 0.1
    assert bits(rng.integers(0, 256, 100_000).astype(np.uint8).tobytes()) < 8.6
    once = rng.integers(97, 123, 3000).astype(np.uint8).tobytes()
    assert bits(once * 2) < 0.6 * bits(once)
