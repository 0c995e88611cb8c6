"""A byte model by online logistic mixing of hashed-context bit predictors.

Symbols are the bytes of a text, A-Z lower-cased, and an end symbol. A symbol is coded
as the bits of its path in a binary tree (a Huffman tree for each common triple or pair of
preceding symbols), so that likely symbols take few bits; rare ones take the path of an escape and
then eight bits. For each bit these predictors give a log-odds:

* contexts (the last 4 and 6 symbols, and the word so far), each with a slot of its hashed
  table, whose statistics were counted over the training texts;
* a match: the symbol that followed the last place of the text with the same 6 symbols,
  the surer the longer the match has held;
* the text itself, where there is no match: after an escape, how often its earlier bytes took
  either branch; before, whether the branch leads to the escape.

The mixer adds the log-odds up with weights out of a set that a gate chooses (by how many
contexts know the bit and how long the match is), squashes the sum to a probability and
refines it with an adaptive map of log-odds to observed frequencies.

All that is learned from a text itself (matches, branches, weights, map) is learned online:
a bit is predicted from earlier bits of the text only, and the state is kept through the
whole text. Weights and map follow at the ends of blocks, of 32 bits at first and 2048
later, so that the blocks of many texts advance together. A text of over CHUNK symbols
is read in pieces that hand on weights and map; matches reach back within a piece. The
score of a text depends on nothing but the text and the trained tables.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

END = 256
SYMBOLS = 257
_NO_BYTE = 255  # in no UTF-8 text
#: Lengths of the contexts of symbols; the word so far comes on top.
ORDERS = (4, 6)
CONTEXTS = len(ORDERS) + 1
TABLE_BITS = (22, 23, 23)
CHUNK = 1 << 17
#: Symbols whose bits are made at a time, bits of texts that advance together and of a block that advances at a time, and symbols that are counted at a time.
PART = 1 << 17
GROUP = 1 << 21
TILE = 1 << 16
COUNTED = 1 << 19
CARRY = 64
PAD = 8
MAX_DEPTH = 28
#: Contexts of two and of three symbols with a tree of their own, at most, and the least count of such a context.
OWN_TREES = (1200, 4000)
MIN_TREE = 500
#: A symbol of a smaller share than this has no leaf of its own.
RARE = 2.0**-11
MATCH = max(ORDERS)
#: Log-odds of a match that has held for so many symbols (a power of 2).
TRUST = np.array([0.7, 1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5, 6, 7, 8], np.float32)
#: The place in it for a match that has held for 0, 1, 2-3, 4-7, ... symbols.
_LEVEL = np.array([n.bit_length() for n in range((1 << len(TRUST) - 1) + 1)]).clip(max=len(TRUST) - 1).astype(np.int8)
_MATCH_GATE = np.array([0, 1, 1, 2, 2, 2, 3, 3, 3, 3, 3, 3, 3])
ESCAPING = 2.0
INPUTS = CONTEXTS + 1
GATES = 4 * (CONTEXTS + 1) + 1
BLOCKS = (0, 32, 64, 128, 256, 512, 1024, 2048)
BUCKETS = 49
LIMIT = 12.0
SCALE = 16.0
UNSEEN = -128
#: Weights to start from: of contexts, and of the last input, by whether it is a match (gate), an escape or a branch.
START, START_MATCH, START_ESCAPE, START_BRANCH = 0.35, 0.5, 0.0, 0.5
RATE = 0.04
MAP_PRIOR = 24.0
_HASH = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_ROLL = 0x100000001B3
_UNROLL = pow(_ROLL, -1, 1 << 64)
_SPACE = np.zeros(SYMBOLS, bool)
_SPACE[[9, 10, 11, 12, 13, 32, END]] = True


class Trees:
    """For each context of preceding symbols, the length and bits of every symbol's path.

    Made from the counts (context * SYMBOLS + symbol, count) of all contexts of one symbol, and of those contexts of two and
    of three that shall have a tree of their own; any other context has the tree of its longest end that has one.
    """

    def __init__(self, one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], three: tuple[np.ndarray, np.ndarray]):
        weights = [np.bincount(one[0], one[1], SYMBOLS * SYMBOLS).reshape(SYMBOLS, SYMBOLS)]
        self.two = np.tile(np.arange(SYMBOLS), SYMBOLS)
        self.row = np.zeros(SYMBOLS * SYMBOLS, np.int64)  # of the first two symbols of three
        self.three = np.full(SYMBOLS, -1)
        n = SYMBOLS
        for counts in (two, three):
            context, at = np.unique(counts[0] // SYMBOLS, return_inverse=True)
            weights.append(np.bincount(at * SYMBOLS + counts[0] % SYMBOLS, counts[1], len(context) * SYMBOLS).reshape(-1, SYMBOLS))
            if counts is two:
                self.two[context] = n + np.arange(len(context))
            else:
                pairs, at = np.unique(context // SYMBOLS, return_inverse=True)
                self.row[pairs] = 1 + np.arange(len(pairs))
                self.three = np.full((1 + len(pairs)) * SYMBOLS, -1)
                self.three[(1 + at) * SYMBOLS + context % SYMBOLS] = n + np.arange(len(context))
            n += len(context)
        self.length = np.zeros((n, SYMBOLS), np.uint8)
        self.code = np.zeros((n, SYMBOLS), np.uint32)
        self.rare = np.zeros((n, SYMBOLS), bool)
        self.escape_length = np.zeros(n, np.uint8)
        self.escape_code = np.zeros(n, np.uint32)
        overall = weights[0].sum(0) + 1.0
        overall /= overall.sum()
        for k, own in enumerate(np.concatenate(weights)):
            self._build(k, own + overall)
        to_escape = _shared(self.length, self.code, self.escape_length[:, None], self.escape_code[:, None])
        #: All that bits take from a path in one number: the code, the length, the steps shared with the escape, and the escape's length if the symbol is rare.
        self.packed = self.code.astype(np.int64) | self.length.astype(np.int64) << 32 | to_escape.astype(np.int64) << 40
        self.packed |= np.where(self.rare, self.escape_length[:, None], MAX_DEPTH).astype(np.int64) << 48
        self.path_bits = (self.length.size - 1).bit_length()
        self.row, self.two, self.three = self.row.astype(np.int32), self.two.astype(np.int32), self.three.astype(np.int32)

    def of(self, s: np.ndarray) -> np.ndarray:
        """The tree of each position but the first three."""
        pair = s[:-2] * SYMBOLS + s[1:-1]
        own = _taken(self.three, _taken(self.row, pair[:-1]) * np.int64(SYMBOLS) + s[2:-1])
        return np.where(own >= 0, own, _taken(self.two, pair[1:])).astype(np.int64)

    def _build(self, k: int, weight: np.ndarray) -> None:
        """The tree of the symbols that aren't rare, the end and an escape, and eight bits more for each rare symbol."""
        share = weight / weight.sum()
        leaf = share >= RARE
        leaf[END] = True
        escaped = float(share[~leaf].sum())
        heap = [(max(float(share[i]), RARE / 2), int(i), int(i)) for i in np.flatnonzero(leaf)] + [(max(escaped, RARE), SYMBOLS, SYMBOLS)]
        heapq.heapify(heap)
        children: dict[int, tuple[int, int]] = {}
        fresh = SYMBOLS + 1
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[fresh] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], fresh, fresh))
            fresh += 1
        level, escape = [(heap[0][2], 0, 0)], (0, 0)
        while level:
            below = []
            for node, code, depth in level:
                if node == SYMBOLS:
                    escape = (code, depth)
                elif node < SYMBOLS:
                    self.code[k, node], self.length[k, node] = code, depth
                else:
                    below += [(child, code << 1 | bit, depth + 1) for bit, child in enumerate(children[node])]
            level = below
        self.escape_code[k], self.escape_length[k] = escape
        rare = np.flatnonzero(~leaf)
        self.code[k, rare], self.length[k, rare] = escape[0] << 8 | rare, escape[1] + 8
        self.rare[k] = ~leaf


def gram_counts(s: np.ndarray, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coded symbols with the three before each, as numbers in base SYMBOLS, and how often they occur."""
    small = np.where(s == END, _NO_BYTE, s).astype(np.uint32)
    key = np.zeros(len(small) - 3, np.uint32)
    for k in (3, 2, 1, 0):
        key <<= np.uint32(8)
        key |= small[3 - k : len(small) - k]
    keys, n = np.unique(key[coded[3:]], return_counts=True)
    digits = [(keys >> np.uint32(8 * k)).astype(np.int64) & 255 for k in (3, 2, 1, 0)]
    out = np.zeros(len(keys), np.int64)
    for d in digits:
        out = out * SYMBOLS + np.where(d == _NO_BYTE, END, d)
    return out, n


def added_up(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of several such counts."""
    keys, at = np.unique(np.concatenate([k for k, _ in counts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in counts]), len(keys)).astype(np.int64)


def pieces(texts: list[bytes], least: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of (symbols, coded, text) that end where they have ``least`` symbols: with padding or carried context before each piece of a text, which isn't coded there."""
    parts: list[tuple[np.ndarray, int, int]] = []
    size = 0

    def chunk():
        symbols = np.concatenate([p[0] for p in parts]).astype(np.int64)
        coded = np.ones(len(symbols), bool)
        owner = np.repeat([p[2] for p in parts], [len(p[0]) for p in parts])
        at = 0
        for p, skip, _ in parts:
            coded[at : at + skip] = False
            at += len(p)
        return symbols, coded, owner

    pad = np.full(PAD, END, np.uint16)
    for i, text in enumerate(texts):
        whole = np.concatenate([pad, np.frombuffer(text.lower(), np.uint8).astype(np.uint16), pad[:1]])
        for at in range(PAD, len(whole), CHUNK):
            before = max(0, at - CARRY)
            parts.append((whole[before : at + CHUNK], at - before, i))
            size += len(parts[-1][0])
            if size >= least:
                yield chunk()
                parts, size = [], 0
    if parts:
        yield chunk()


def _powers(of: int, n: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


class _Rolls:
    """Powers of the base of the rolling hash of words, and their inverses, as far as they were needed yet."""

    n = 0

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n, self.power, self.inverse = n, _powers(_ROLL, n), _powers(_UNROLL, n)
        return self.power[:n], self.inverse[:n]


_rolls = _Rolls()


def _contexts(s: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The slot that each context before each position starts from, and a hash of the longest."""
    u = s.astype(np.uint64)
    following = u + np.uint64(1)
    out, v = [], np.zeros(len(u), np.uint64)
    for k in range(1, max(ORDERS) + 1):
        v *= np.uint64(SYMBOLS)
        v[k:] += following[:-k]
        if k in ORDERS:
            out.append(v.copy())
    power, inverse = _rolls(len(u))
    sums = np.zeros(len(u) + 1, np.uint64)
    np.cumsum(following * power, out=sums[1:])
    start = np.zeros(len(u) + 1, np.int64)
    np.maximum.accumulate(np.where(_taken(_SPACE, s), np.arange(1, len(s) + 1), 0), out=start[1:])
    start = start[:-1]  # of the word that position i goes on
    word = (sums[:-1] - sums.take(start)) * inverse.take(start)
    word[1:] += u[:-1]
    slots = [((h * m) >> np.uint64(64 - bits)).astype(np.int32) for h, m, bits in zip([*out, word], _HASH, TABLE_BITS, strict=True)]
    return slots, v


def _ways(length: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first bit of each of these paths; and of each bit the symbol, how many bits of the path come after it, the node and the value."""
    first = np.cumsum(length, dtype=np.int64) - length
    begins = np.zeros(int(length.sum()), np.int8)
    begins[first[1:]] = 1  # no path is empty
    symbol = np.cumsum(begins, dtype=np.int64)
    after = _taken((first + length - 1).astype(np.int32), symbol)
    after -= np.arange(len(symbol), dtype=np.int32)
    node = _taken(code | np.int32(1) << length, symbol)
    node >>= after
    bit = node.astype(np.int8)
    bit &= 1
    node >>= 1  # a 1 and the way to the node name it
    return first, symbol, after, node, bit


class Bits:
    """The bits of the coded symbols of a chunk: how many come after each on its path, the value, the node and the slot in each table."""

    def __init__(self, s: np.ndarray, coded: np.ndarray, trees: Trees):
        self.at = np.flatnonzero(coded)
        self.tree = trees.of(s).take(self.at - 3)
        self.path = path = self.tree * SYMBOLS + s.take(self.at)
        packed = _taken(trees.packed, path)
        self.code, self.length = packed.astype(np.int32), (packed >> 32).astype(np.int8).astype(np.int32)
        self.to_escape, self.escape = (packed >> 40).astype(np.int8), (packed >> 48).astype(np.int8)
        self.first, self.symbol, after, self.node, self.bit = _ways(self.length, self.code)
        self.after = after.astype(np.int8)
        self.slots = []
        contexts, self.past = _contexts(s)  # the latter of the last MATCH symbols
        for h, bits in zip(contexts, TABLE_BITS, strict=True):
            slot = self.each(h.take(self.at))
            slot += self.node
            slot &= np.int32((1 << bits) - 1)
            self.slots.append(slot)

    def after_escapes(self) -> tuple[np.ndarray, np.ndarray]:
        """The bits after an escape, and a number for the way from the escape to each."""
        rare = np.flatnonzero(self.escape < MAX_DEPTH)
        after = ((self.first.take(rare) + self.escape.take(rare))[:, None] + np.arange(8)).reshape(-1)
        top = np.tile(np.int32(1) << np.arange(8, dtype=np.int32), len(rare))
        return after, self.node.take(after) & (top - 1) | top

    def each(self, of_symbol: np.ndarray) -> np.ndarray:
        """What each symbol has, for each of its bits."""
        return _taken(of_symbol, self.symbol)

    def along(self, shared: np.ndarray) -> np.ndarray:
        """By how many steps the path of each symbol shares with another one (-1 without one): 1 or -1 where that one goes to 1 or 0 from the node of a bit, 0 where it doesn't pass that node."""
        way = self.each((shared - (self.length - 1)).astype(np.int8))
        way += self.after  # the steps that are shared, less the depth of the bit
        out = (way > 0).view(np.int8)
        out += out
        out -= (way >= 0).view(np.int8)
        out *= self.bit + self.bit - np.int8(1)
        return out


def _shared(length: np.ndarray, code: np.ndarray, other_length: np.ndarray, other_code: np.ndarray) -> np.ndarray:
    """How many steps two paths have in common."""
    apart = (code.astype(np.int64) << (MAX_DEPTH - length.astype(np.int64))) ^ (other_code.astype(np.int64) << (MAX_DEPTH - other_length.astype(np.int64)))
    return (MAX_DEPTH - np.frexp(apart.astype(np.float64))[1]).astype(np.int32)


def _taken(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at] for valid places, flat; this mode is the fast one."""
    return values.reshape(-1).take(at, mode="clip")


def _matches(s: np.ndarray, at: np.ndarray, owner: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of these positions the symbol after the last equal context (hashed in ``past``) of its text (or -1), and for how many symbols it has been right."""
    h = owner.astype(np.uint64)
    h *= _HASH[1]
    h ^= past
    h *= _HASH[0]
    bits = np.uint64((2 * CHUNK).bit_length())
    key = h.take(at)
    key >>= bits
    key <<= bits
    key |= np.arange(len(at), dtype=np.uint64)
    key.sort()
    where = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int32)
    key >>= bits
    symbol, text = s.take(at).astype(np.int32), owner.take(at).astype(np.int32)
    now, then = where[1:], where[:-1]
    same = np.flatnonzero(key[1:] == key[:-1])
    now, then = now.take(same), then.take(same)
    own = text.take(now) == text.take(then)
    guess = np.full(len(at), -1, np.int32)
    guess[now[own]] = symbol.take(then[own])
    i = np.arange(len(at), dtype=np.int32)
    going_on = np.zeros(len(at), bool)
    going_on[1:] = text[1:] == text[:-1]
    broken = np.maximum.accumulate(np.where((guess == symbol) & going_on, 0, i))  # the last symbol that wasn't foretold
    held = np.zeros(len(at), np.int32)
    held[1:] = (i[:-1] - broken[:-1]) * going_on[1:]
    return guess, held


def slot_counts(texts: list[bytes], trees: Trees, counts: list[np.ndarray]) -> None:
    """Add the bits of texts to counts[context][2 * slot + bit]."""
    waiting: list[list[np.ndarray]] = [[] for _ in counts]
    size = 0
    for s, coded, _ in pieces(texts, min(PART, CHUNK)):
        at = np.flatnonzero(coded)
        path = trees.of(s).take(at - 3) * SYMBOLS + s.take(at)
        for found, slot in zip(waiting, _contexts(s)[0], strict=True):
            key = slot.take(at).astype(np.int64)
            key <<= trees.path_bits
            key |= path
            found.append(key)
        size += len(at)
        if size >= COUNTED:
            _count(waiting, trees, counts)
            waiting, size = [[] for _ in counts], 0
    if size:
        _count(waiting, trees, counts)


def _count(found: list[list[np.ndarray]], trees: Trees, counts: list[np.ndarray]) -> None:
    """Add the bits of symbols, each given as (slot of its context, path): those that are alike go along the path once."""
    for table, bits, parts in zip(counts, TABLE_BITS, found, strict=True):
        key = np.concatenate(parts)
        key.sort()
        fresh = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        first = np.flatnonzero(fresh)
        times = np.diff(first, append=len(key)).astype(table.dtype)
        key = key.take(first)
        start, path = (key >> trees.path_bits).astype(np.int32), key & ((1 << trees.path_bits) - 1)
        packed = _taken(trees.packed, path)
        _, symbol, _, node, bit = _ways((packed >> 32).astype(np.int8).astype(np.int32), packed.astype(np.int32))
        slot = _taken(start, symbol)
        slot += node
        slot &= (1 << bits) - 1
        slot += slot
        slot += bit
        np.add.at(table, slot, _taken(times, symbol))


def log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """What the tables hold: scaled log-odds as int8, or UNSEEN."""
    odds = np.log((ones + 0.2) / (zeros + 0.2)) * SCALE
    return np.where(zeros + ones > 0, np.clip(np.rint(odds), -127, 127), UNSEEN).astype(np.int8)


def _branch_odds(bits: Bits, after: np.ndarray, branch: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For the bits after an escape, the log-odds by how often the earlier ones of the same text and branch were 1."""
    key = owner.take(bits.at).take(bits.symbol.take(after)).astype(np.int64) * 256 + branch
    order = np.argsort(key, kind="stable")
    key, bit = key[order], bits.bit[after][order].astype(np.int64)
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    ones = np.cumsum(bit) - bit
    ones = ones - ones[start]
    zeros = np.arange(len(key)) - start - ones
    out = np.empty(len(key), np.float32)
    out[order] = np.log((ones + 0.4) / (zeros + 0.4))
    return out


def _spread(at: np.ndarray, n: int) -> np.ndarray:
    """Four places for each one of n, taken in turn: sums at the same place needn't wait for each other."""
    for k in (1, 2, 3):
        at[k::4] += k * n
    return at


def _sums(spread: np.ndarray, values: np.ndarray | None, n: int) -> np.ndarray:
    """The sums (or counts) at n places, from their spread ones."""
    return np.bincount(spread, values, 4 * n).reshape(4, n).sum(0)


_PAIR = np.array([1.0, 1.0 + (1 << 26)])  # exact up to 2^26 bits of a block


class _State:
    """Weights and maps of the texts of a chunk, a row for each."""

    def __init__(self, texts: int):
        self.weights = np.full((INPUTS, texts, GATES), START, np.float32)
        self.weights[-1] = [START_MATCH if g % 4 else START_ESCAPE for g in range(GATES - 1)] + [START_BRANCH]
        centres = (np.arange(BUCKETS) - BUCKETS // 2) * (2 * LIMIT / (BUCKETS - 1))
        self.seen = np.full((texts, BUCKETS), MAP_PRIOR)
        self.ones = np.tile(MAP_PRIOR / (1 + np.exp(-centres)), (texts, 1))

    def go_on(self, before: _State) -> None:
        """The first text is the last of the chunk before."""
        self.weights[:, 0], self.seen[0], self.ones[0] = before.weights[:, -1], before.seen[-1], before.ones[-1]


class Mixer:
    def __init__(self, trees: Trees, tables: list[np.ndarray]):
        self.trees, self.tables = trees, tables

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The natural-log probability of each text; texts that are alike are scored once."""
        places: dict[bytes, int] = {}
        at = [places.setdefault(text.lower(), len(places)) for text in texts]
        return self._score(list(places)).take(at)

    def _score(self, texts: list[bytes]) -> np.ndarray:
        total = np.zeros(len(texts))
        state, holder = None, -1
        for first, parts in self._groups(texts):
            length = np.concatenate([p[0] for p in parts])
            before, state = state, _State(len(length))
            if holder == first:  # the text goes on from the chunk before
                state.go_on(before)
            holder = first + len(length) - 1
            total[first : holder + 1] += self._advance(parts, length, state)
        return total

    def _groups(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
        """Texts that advance together, of some GROUP bits: the first one's number, and in parts the bits of each and what ``_inputs`` gives. A group has one piece of a text at most."""
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = first = last = 0
        for s, coded, owner in pieces(texts, min(PART, CHUNK)):
            if parts and (size >= GROUP or int(owner[0]) == last):
                yield first, parts
                parts, size = [], 0
            if not parts:
                first = int(owner[0])
            last = int(owner[-1])
            owner = owner - owner[0]
            bits = Bits(s, coded, self.trees)
            ends = np.cumsum(np.bincount(owner.take(bits.at)))  # of the symbols of each text
            length = np.diff(np.append(bits.first, len(bits.bit)).take(ends), prepend=0)
            parts.append((length, *self._inputs(bits, s, owner)))
            size += len(bits.bit)
        if parts:
            yield first, parts

    def _inputs(self, bits: Bits, s: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each bit the scaled log-odds of the contexts, the gate and the value; and the log-odds of the last input."""
        columns = np.empty((CONTEXTS + 2, len(bits.bit)), np.int8)
        known = np.zeros(len(bits.bit), np.int8)
        for odds, table, slot in zip(columns, self.tables, bits.slots, strict=False):
            table.take(slot, mode="clip", out=odds)
            seen = odds != UNSEEN
            known += seen
            odds *= seen
        guess, held = _matches(s, bits.at, owner, bits.past)
        shared = np.where(guess == s.take(bits.at), bits.length, np.int32(-1))
        wrong = np.flatnonzero((guess >= 0) & (shared < 0))
        at = bits.tree.take(wrong) * SYMBOLS + guess.take(wrong)
        shared[wrong] = _shared(bits.length.take(wrong), bits.code.take(wrong), _taken(self.trees.length, at), _taken(self.trees.code, at))
        way = bits.along(shared)
        level = _LEVEL.take(held, mode="clip")
        gate = bits.each(_MATCH_GATE.take(level + 1).astype(np.int8))
        matched = way != 0
        gate *= matched
        gate += known * np.int8(4)
        escape = bits.along(bits.to_escape)
        escape *= ~matched
        way = way * bits.each(TRUST.take(level))
        way += escape * np.float32(ESCAPING)
        after, branch = bits.after_escapes()
        alone = ~matched.take(after)
        way[after] = np.where(alone, _branch_odds(bits, after, branch, owner), way.take(after))
        gate[after[alone]] = GATES - 1
        columns[CONTEXTS], columns[CONTEXTS + 1] = gate, bits.bit
        return columns, way

    def _advance(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: np.ndarray, state: _State) -> np.ndarray:
        """Run the blocks of all texts side by side, some TILE bits at a time; the natural-log probability of each text here."""
        start = np.concatenate([np.cumsum(p[0]) - p[0] for p in parts])
        columns, way = ([p[k] for p in parts for _ in p[0]] for k in (1, 2))
        total = np.zeros(len(length))
        edge, t = 0, 0
        while (live := np.flatnonzero(length > edge)).size:
            t += 1
            until = BLOCKS[t] if t < len(BLOCKS) else edge + BLOCKS[-1]
            step = max(1, TILE // (until - edge))
            for k in range(0, len(live), step):
                some = live[k : k + step]
                n = np.minimum(length[some], until) - edge
                spans = list(zip(some.tolist(), (start[some] + edge).tolist(), (start[some] + edge + n).tolist(), strict=True))
                total[some] += self._block(np.concatenate([columns[k][:, lo:hi] for k, lo, hi in spans], axis=1), np.concatenate([way[k][lo:hi] for k, lo, hi in spans]), n, some, state)
            edge = until
        return total

    def _block(self, columns: np.ndarray, way: np.ndarray, n: np.ndarray, some: np.ndarray, state: _State) -> np.ndarray:
        """The natural-log probability of a block of n bits of each of some texts; their weights and maps follow."""
        scale = np.float32((BUCKETS - 1) / (2 * LIMIT))
        low, high, half = np.float32(-LIMIT), np.float32(LIMIT), np.float32(0.5)
        lane = np.arange(len(some))
        x = [*(columns[:CONTEXTS] * np.float32(1 / SCALE)), way]
        y = columns[CONTEXTS + 1]
        weights, seen, ones = (a[..., some, :].reshape(*a.shape[:-2], -1) for a in (state.weights, state.seen, state.ones))
        row = np.repeat(lane * GATES, n)
        row += columns[CONTEXTS]
        dot = _taken(weights[0], row) * x[0]
        for w, column in zip(weights[1:], x[1:], strict=True):
            dot += _taken(w, row) * column
        np.clip(dot, low, high, out=dot)
        p = 1 / (1 + np.exp(-dot))
        dot += high
        dot *= scale
        dot += half
        cell = np.repeat(lane * BUCKETS, n)
        cell += dot.astype(np.int32)
        final = p + _taken((ones / seen).astype(np.float32), cell)
        final *= half
        chance = np.abs(final - (1 - y).astype(np.float32))  # of the bit that came
        found = np.add.reduceat(np.log(chance), np.cumsum(n) - n)
        # what this block teaches
        error = y - p
        row, cell = _spread(row, weights.shape[1]), _spread(cell, len(seen))
        rate = RATE / (1 + _sums(row, None, weights.shape[1]) / 24)
        for w, column in zip(weights, x, strict=True):
            column *= error
            w += rate * _sums(row, column, len(w))
        # one sum counts the bits and, in its upper half, the ones
        both = _sums(cell, _PAIR.take(y), len(seen)).astype(np.int64)
        seen += both & ((1 << 26) - 1)
        ones += both >> 26
        for a, new in zip((state.weights, state.seen, state.ones), (weights, seen, ones), strict=True):
            a[..., some, :] = new.reshape(*a.shape[:-2], len(some), -1)
        return found
