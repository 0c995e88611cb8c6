"""A static range asymmetric numeral system (rANS) for token ids.

A ``Table`` gives each id a share of 2**bits slots. A block of ids is dealt to
``lanes`` interleaved coder states (id i to lane i % lanes), each a 64-bit number that
sheds 32-bit words; all lanes advance together. The words of a block are stored in the
order in which the decoder takes them. Every ``CHECKPOINT`` steps the states and the
position in the words are noted, so that a block can be decoded from several places at
once; a CRC-32 of its ids closes it. Blocks don't depend on each other.

A segment holds the ids of whole documents: a directory of (doc_id, length), and their
ids one after the other in blocks. Layout, all little-endian:

    "AERORANS" | version u16 | bits u16 | table crc u32 | documents u64 | ids u64 | blocks u32
    valid u8[documents] | doc_id i64[documents] | length u64[documents]
    for each block: ids u32 | lanes u32 | words u32 | checkpoints u32 | crc u32
    for each block: states u64[lanes] | (step u32, word u32, states u64[lanes])[checkpoints] | words u32[words]
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

import numpy as np

MAGIC = b"AERORANS"
VERSION = 1
BITS = 20
BLOCK = 1 << 19
MAX_LANES = 1024
CHECKPOINT = 256
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_HEAD = struct.Struct("<8sHHIQQI")
_BLOCK = struct.Struct("<IIIII")


class Table:
    """Frequencies of all ids, scaled to 2**bits; an id that was never counted has none and can't be encoded."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.bits = bits
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.crc = zlib.crc32(struct.pack("<H", bits) + freq.astype("<u4").tobytes())

    @classmethod
    def from_counts(cls, counts: np.ndarray, bits: int = BITS) -> Table:
        counts = counts.astype(np.float64)
        seen = int((counts > 0).sum())
        bits = max(bits, seen.bit_length() + 1)
        if not seen:
            counts = np.ones(max(1, len(counts)))
            bits = max(bits, len(counts).bit_length() + 1)
        total = 1 << bits
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts / counts.sum() * total)), 0).astype(np.int64)
        gap = total - int(freq.sum())
        order = np.argsort(-freq, kind="stable")
        if gap > 0:
            freq[order[0]] += gap
        while gap < 0:  # the rare ids were raised to 1: the commonest pay for it
            for i in order:
                give = min(int(freq[i]) // 2, -gap)
                freq[i] -= give
                gap += give
                if not gap:
                    break
        return cls(freq, bits)

    def pack(self) -> bytes:
        return struct.pack("<HI", self.bits, len(self.freq)) + self.freq.astype("<u4").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        bits, n = struct.unpack_from("<HI", data)
        return cls(np.frombuffer(data, "<u4", n, 6).astype(np.int64), bits)


def encode_block(ids: np.ndarray, table: Table) -> tuple[bytes, bytes]:
    """The directory entry and the body of a block."""
    n = len(ids)
    lanes = min(MAX_LANES, 1 << max(0, (n // 64).bit_length() - 1))
    steps = -(-n // lanes)
    padded = np.full(steps * lanes, int(table.freq.argmax()), np.int64)
    padded[:n] = ids
    grid = padded.reshape(steps, lanes)
    bits, shift = np.uint64(table.bits), np.uint64(63 - table.bits)
    x = np.full(lanes, _LOW)
    words, marks, sent = [], [], 0
    for t in range(steps - 1, -1, -1):
        f = table.freq[grid[t]]
        full = x >= f << shift
        out = x[full]
        words.append(out.astype("<u4"))
        sent += len(out)
        x[full] = out >> _WORD
        q = x // f
        x = (q << bits) + (x - q * f) + table.start[grid[t]]
        if t and t % CHECKPOINT == 0:
            marks.append((t, sent, x.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    body = [x.astype("<u8").tobytes()]
    for t, before, states in reversed(marks):
        body.append(struct.pack("<II", t, len(stream) - before) + states.astype("<u8").tobytes())
    body.append(stream.tobytes())
    return _BLOCK.pack(n, lanes, len(stream), len(marks), zlib.crc32(ids.astype("<u4").tobytes())), b"".join(body)


def _run(states: list[np.ndarray], words: np.ndarray, at: list[int], steps: list[int], table: Table) -> np.ndarray:
    """The ids of several parts of a block, one after another; all advance together, each from its own states and words. Longer parts come first."""
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    x, place = np.stack(states), np.array(at, np.int64)
    out = np.empty((len(states), steps[0], x.shape[1]), np.uint32)
    for t in range(steps[0]):
        live = sum(n > t for n in steps[-2:]) + len(steps[:-2])  # the last part may be shorter
        y = x[:live]
        slot = y & mask
        s = out[:live, t] = table.slots[slot]
        y = table.freq[s] * (y >> bits) + slot - table.start[s]
        low = y < _LOW
        taken = np.cumsum(low, axis=1)
        if taken[:, -1].any():
            y[low] = y[low] << _WORD | words[(place[:live, None] + taken - 1)[low]]
            place[:live] += taken[:, -1]
        x[:live] = y
    return np.concatenate([o[:n].ravel() for o, n in zip(out, steps, strict=True)])


def decode_block(entry: bytes, body: memoryview, table: Table, parts: Iterable[int] | None = None) -> np.ndarray:
    """The ids of a block, all checkpoint parts side by side; ``parts`` decodes only these (0 is the block's start), without the checksum."""
    n, lanes, n_words, n_marks, crc = _BLOCK.unpack(entry)
    steps = -(-n // lanes) if n else 0
    starts = [(0, 0, np.frombuffer(body, "<u8", lanes).astype(np.uint64))]
    at = 8 * lanes
    for _ in range(n_marks):
        t, word = struct.unpack_from("<II", body, at)
        starts.append((t, word, np.frombuffer(body, "<u8", lanes, at + 8).astype(np.uint64)))
        at += 8 + 8 * lanes
    words = np.frombuffer(body, "<u4", n_words, at).astype(np.uint64)
    ends = [s[0] for s in starts[1:]] + [steps]
    chosen = range(len(starts)) if parts is None else sorted(parts)
    lengths = [ends[k] - starts[k][0] for k in chosen]
    ids = _run([starts[k][2] for k in chosen], words, [starts[k][1] for k in chosen], lengths, table)
    if chosen and chosen[-1] == len(starts) - 1:
        ids = ids[: len(ids) - (steps * lanes - n)]
    if parts is None and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's checksum doesn't match")
    return ids


def body_size(entry: bytes) -> int:
    _, lanes, n_words, n_marks, _ = _BLOCK.unpack(entry)
    return 8 * lanes + n_marks * (8 + 8 * lanes) + 4 * n_words


def encode_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, table: Table) -> bytes:
    blocks = [encode_block(ids[at : at + BLOCK], table) for at in range(0, len(ids), BLOCK)]
    head = _HEAD.pack(MAGIC, VERSION, table.bits, table.crc, len(doc_ids), len(ids), len(blocks))
    valid = np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    keys = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    return b"".join([head, valid, keys, np.array(lengths, "<u8").tobytes(), *(b[0] for b in blocks), *(b[1] for b in blocks)])


def decode_segment(data: bytes, table: Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and all ids of a segment."""
    magic, version, bits, crc, n_docs, n_ids, n_blocks = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION or bits != table.bits or crc != table.crc:
        raise ValueError("not a segment of this version and table")
    view, at = memoryview(data), _HEAD.size
    valid = np.frombuffer(view, np.uint8, n_docs, at)
    keys = np.frombuffer(view, "<i8", n_docs, at + n_docs)
    lengths = np.frombuffer(view, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 17 * n_docs
    entries = [bytes(view[at + _BLOCK.size * k : at + _BLOCK.size * (k + 1)]) for k in range(n_blocks)]
    at += _BLOCK.size * n_blocks
    parts = []
    for entry in entries:
        size = body_size(entry)
        parts.append(decode_block(entry, view[at : at + size], table))
        at += size
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if len(ids) != n_ids:
        raise ValueError("a segment is cut short")
    return [int(k) if v else None for k, v in zip(keys, valid, strict=True)], lengths, ids
