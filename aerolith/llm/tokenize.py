"""Exact, memoised encoding with a vocabulary file of the tokenizers library.

Both supported kinds split a text before merging, and never merge across a split, so
that a text's ids are those of its chunks one after the other. A chunk's ids are kept
in a bounded memory; a new chunk of plain letters, digits and marks goes piece by
piece to the library's model, any other to the library's whole encoder. A word with a
mark after it shares the memory of the word alone; a line feed between words starts a chunk. A text whose
white space could make chunks depend on each other is encoded whole, as is one that
holds the string of an added token (such as ``<|endoftext|>``), which is one id there.

``encode`` returns the ids as little-endian unsigned integers of ``width`` bytes;
``encode_all`` does so for a column of texts, and looks each distinct word up once.
"""

from __future__ import annotations

import functools
import gc
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMORY = 600_000
#: Characters for which case, normal form and class are the same everywhere: printable ASCII and Latin-1 letters.
_PLAIN = re.compile("[ -~À-ÖØ-öø-ÿ]*")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: By far the commonest chunks: a word, perhaps with marks after it.
_COMMON = re.compile(f"([{_LETTERS}]+)([!-/:-@]*)")
#: Bytes of white space other than single spaces and line feeds (UTF-8, with some that only start like it).
_OTHER_SPACE = (b"\t", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    table.update({b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in table)})
    return table


class _Memory(dict):
    """Results by key. A key that comes again stays; those seen once lie in two generations, of which the older goes when the younger is full."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.young: dict = {}
        self.old: dict = {}

    def __missing__(self, key):
        out = self.young.get(key)
        if out is None:
            out = self.old.get(key)
        if out is None:
            out = self.make(key)
            if len(self.young) >= MEMORY // 6:
                self.old, self.young = self.young, {}
            self.young[key] = out
            return out
        if len(self) >= MEMORY * 2 // 3:
            self.clear()
        self[key] = out
        return out

    def all(self, keys: list) -> list:
        """The results of distinct keys."""
        out = list(map(self.get, keys))
        for i in [i for i, x in enumerate(out) if x is None]:
            out[i] = self[keys[i]]
        return out


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.width = 2 if self.size <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]  # found in the text as it is, before the split
        self.drops_space = self.tokenizer.normalizer is not None  # the kind with word ends: lower case, white space dropped
        self.pack = "H" if self.width == 2 else "I"
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.space = _byte_letters()[0x20]
        mark = rf"[^\s{_LETTERS}0-9]+"
        parts = rf"[{_LETTERS}]+|[0-9]|{mark}" if self.drops_space else rf" ?[{_LETTERS}]+| ?[0-9]+| ?{mark}|\s+(?!\S)|\s+"
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{parts}")
        self.pieces = _Memory(self._piece)
        self.chunks = _Memory(self._word) if self.drops_space else _Memory(self._spaced)
        self.first = _Memory(self._word)

    def _pack(self, ids: list[int]) -> bytes:
        out = array(self.pack, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii() or piece[0] < "!":
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return self._pack([t.id for t in self.model.tokenize(piece)])

    def whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, chunk: bytes) -> bytes:
        if self.drops_space and chunk.isalpha():  # ASCII letters only
            return self._pack([t.id for t in self.model.tokenize(chunk.lower().decode())])
        text = chunk.decode()
        if self.drops_space and (common := _COMMON.fullmatch(text)):
            word, mark = common.groups()
            return self.chunks[chunk[: -len(mark)]] + self.pieces[mark] if mark else self._piece(word.lower())
        if not _PLAIN.fullmatch(text):
            return self.whole(text)
        return b"".join([self.pieces[p] for p in self.split.findall(text.lower() if self.drops_space else text)])

    def _spaced(self, chunk: bytes) -> bytes:
        if chunk[:1] == b"\n":  # between words, a piece of its own
            return self.pieces["\n"] + self.first[chunk[1:]]
        if chunk.isalpha():
            return self._pack([t.id for t in self.model.tokenize(self.space + chunk.decode())])
        if common := _COMMON.fullmatch(chunk.decode()):
            word, mark = common.groups()
            return self.chunks[chunk[: -len(mark)]] + self.pieces[mark] if mark else self._piece(" " + word)
        return self._word(b" " + chunk)

    def encode(self, text: bytes) -> bytes:
        if any(token in text for token in self.added):
            return self.whole(text.decode())
        if self.drops_space:
            return b"".join(map(self.chunks.__getitem__, text.split()))
        if not text:
            return b""
        if text[0] in b" \n" or text[-1] in b" \n" or b"  " in text or b" \n" in text or b"\n " in text or b"\n\n" in text or any(s in text for s in _OTHER_SPACE):
            return self.whole(text.decode())
        head, *rest = text.replace(b"\n", b" \n").split(b" ")
        return self.first[head] + b"".join(map(self.chunks.__getitem__, rest))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """What ``encode`` gives for each of these strings (null: empty); each distinct word of them is looked up once."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool) if self.drops_space else _odd_space(texts)
        offsets, data = _values(texts)
        if any(token in data for token in self.added):
            whole |= [any(token in data[lo:hi] for token in self.added) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(whole).tolist():
            out[i] = self.whole(data[offsets[i] : offsets[i + 1]].decode())
        plain = np.flatnonzero(~whole)
        if not len(plain):
            return out
        rest = texts.take(pa.array(plain)) if whole.any() else texts
        lists = pc.ascii_split_whitespace(rest) if self.drops_space else pc.split_pattern(pc.replace_substring(rest, "\n", " \n"), " ")
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        words = lists.flatten().dictionary_encode()
        at = words.indices.to_numpy().astype(np.int64)
        ends, data = _values(words.dictionary)
        distinct = [data[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
        heads: list[bytes] = []
        if not self.drops_space:  # the first word has no space before it
            heads = self.first.all([distinct[i] for i in at[edges[:-1]].tolist()])
            at[edges[:-1]] = len(distinct) + np.arange(len(heads))
        used = np.flatnonzero(np.bincount(at, minlength=len(distinct))[: len(distinct)]).tolist()
        ids: list[bytes | None] = [None] * len(distinct)
        for i, x in zip(used, self.chunks.all([distinct[i] for i in used]), strict=True):
            ids[i] = x
        ends, data = _values(pa.array(ids + heads, pa.large_binary()).take(pa.array(at)))
        for i, lo, hi in zip(plain.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            out[i] = data[ends[lo] : ends[hi]]
        return out


def _values(array: pa.Array) -> tuple[list[int], bytes]:
    """The edges of the values of an array of strings or bytes, and these values one after the other."""
    kind = np.int64 if pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type) else np.int32
    _, edges, data = array.buffers()
    edges = np.frombuffer(edges, kind)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, kind)
    return (edges - edges[0]).tolist(), bytes(memoryview(data)[int(edges[0]) : int(edges[-1])]) if data else b""


def _odd_space(texts: pa.Array) -> np.ndarray:
    """Which texts may have other white space than single spaces and line feeds between words (those of ``_OTHER_SPACE`` and some more)."""
    offsets, data = _values(texts)
    edges, b = np.array(offsets, np.int64), np.frombuffer(data, np.uint8)
    space = (b == 0x20) | (b == 0x0A)
    odd = (b < 0x20) & (b != 0x0A)
    odd[1:] |= space[1:] & space[:-1]
    lead = np.flatnonzero((b == 0xC2) | ((b >= 0xE1) & (b <= 0xE3)))
    first, second, third = b[lead], b[(lead + 1) % max(1, len(b))], b[(lead + 2) % max(1, len(b))]
    odd[lead] |= (first == 0xC2) & ((second == 0x85) | (second == 0xA0)) | (first == 0xE1) & (second == 0x9A)
    odd[lead] |= (first == 0xE2) & ((second == 0x80) | (second == 0x81)) | (first == 0xE3) & (second == 0x80) & (third == 0x80)
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(edges, np.flatnonzero(odd), "right") - 1] = True
    some = np.flatnonzero(edges[1:] > edges[:-1])
    out[some] |= space[edges[some]] | space[edges[some + 1] - 1]
    return out


@functools.lru_cache(maxsize=2)
def shared_encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process, so that what it remembers serves the next task too."""
    return Encoder(path)


def forget_encoders() -> None:
    """For the tasks of other operators: a worker that has encoded before gives its encoders up, and Arrow what it holds unused."""
    if shared_encoder.cache_info().currsize:
        shared_encoder.cache_clear()
        gc.collect()  # an encoder and its memories refer to each other
    pa.default_memory_pool().release_unused()
