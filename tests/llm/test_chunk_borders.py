"""Texts longer than the pieces in which operators read them."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aerolith.llm import language_id, packing, rans, token_files

rng = random.Random(6)
LONG = " ".join("".join(rng.choices("aeiou lnrst", k=rng.randint(2, 9))) for _ in range(60_000))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(3, LONG), (1, "short"), (2, LONG[::-1]), (None, None)], "doc_id long, text string").repartition(3)


def ids(name, text, end):
    return np.array([*Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files_of_long_texts(spark, docs, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 5_000)
    monkeypatch.setattr(token_files, "PART_IDS", 20_000)
    monkeypatch.setattr(token_files, "PARTS_A_BLOCK", 2)
    found = {r["doc_id"]: r for r in token_files.write_and_read(docs).collect()}
    at = 0
    for doc, text in [(None, None), (1, "short"), (2, LONG[::-1]), (3, LONG)]:
        want = ids("word_bpe_49k.json", text, 1)
        assert (found[doc]["start"], found[doc]["n_tokens"], found[doc]["ids_crc32"]) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)


def test_packing_of_long_texts(docs):
    found = sorted((r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.pack(docs).collect())
    want = []
    for doc, text in [(0, None), (1, "short"), (2, LONG[::-1]), (3, LONG)]:
        whole = ids("byte_bpe_50k.json", text, 0)
        head = len(whole) % 2048
        edges = [*([0, head] if head else [0]), *range(head + 2048, len(whole) + 1, 2048)]
        want += [(doc, k, lo, hi - lo, zlib.crc32(whole[lo:hi].tobytes())) for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    assert found == want


@pytest.mark.parametrize("n", [0, 1, 700, rans.BLOCK - 1, rans.BLOCK, rans.BLOCK + 300_000])
def test_checkpoint_parts_together_and_alone(n):
    found = np.minimum(np.random.default_rng(n).zipf(1.2, n), 999).astype(np.int64)
    table = rans.Table.from_counts(np.bincount(found, minlength=1000) + 1)
    for at in range(0, n, rans.BLOCK):
        part = found[at : at + rans.BLOCK]
        entry, body = rans.encode_block(part, table)
        whole = rans.decode_block(entry, memoryview(body), table)
        assert whole.tolist() == part.tolist()
        marks = rans._BLOCK.unpack(entry)[3]
        alone = [rans.decode_block(entry, memoryview(body), table, [k]) for k in range(marks + 1)]
        assert np.concatenate(alone).tolist() == part.tolist()


def test_language_of_a_text_over_many_pieces(monkeypatch):
    grams = {"a": (np.array([0x0A0A0A61, 0x61616161]), np.array([3, 9])), "b": (np.array([0x0A0A0A62, 0x62626262]), np.array([3, 9]))}
    model = language_id.Model(["a", "b"], grams)
    texts = [b"ab" * 900 + b"a" * 300, b"b" * 2000, None, b""]
    whole = language_id.classify(texts, [True, True, False, False], model)
    monkeypatch.setattr(language_id, "CHUNK_BYTES", 128)
    cut = language_id.classify(texts, [True, True, False, False], model)
    assert whole[0] == cut[0] and np.allclose(whole[1], cut[1]) and np.allclose(whole[2], cut[2])
