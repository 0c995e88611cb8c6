"""Whole columns of texts against the tokenizers library, and what goes to its whole encoder."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from aerolith.llm.tokenize import Encoder

BITS = ["so", "strange", "Über", "élan", "NO!!", "it's", "x''", "'s", "a,b", "12", "3.5", "...", "\n", " ", "  ", "\t", "\r", "\x00", "\x1c", "\xa0", "\x85", " ", " ", " ", "　", "、", "中文", "αβγ", "é", "<|endoftext|>", "<", "«", "👍"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_columns_are_encoded_as_by_the_library(name):
    encoder, library, rng = Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name)), random.Random(5)
    texts = ["".join(rng.choice(BITS) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(9))) for _ in range(6000)]
    texts += [" ".join(rng.choice(BITS[:12]) + rng.choice(["", "", "\nso", ".\nÉlan"]) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    column = pa.array([None, "", *texts, "", None])
    for part in (column, column.slice(7, 4000), column.slice(3, 0), pa.array(["", None]), pa.nulls(2, pa.string())):
        got = encoder.encode_all(part)
        assert len(got) == len(part)
        for text, ids in zip(part.to_pylist(), got, strict=True):
            assert np.frombuffer(ids, encoder.dtype).tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)
            assert ids == encoder.encode((text or "").encode())


def test_line_feeds_between_words_need_no_whole_encoder(monkeypatch):
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = "so strange.\nÉlan vital\nNO!!\nend"
    expected = encoder.whole(text)
    monkeypatch.setattr(encoder, "whole", None)
    assert encoder.encode(text.encode()) == expected
    assert encoder.encode_all(pa.array([text, text])) == [expected] * 2


def test_words_that_come_again_outlast_those_seen_once(monkeypatch):
    monkeypatch.setattr("aerolith.llm.tokenize.MEMORY", 60)
    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    encoder.encode(b"again again")
    for k in range(0, 500, 10):
        encoder.encode_all(pa.array([" ".join(f"w{i}" for i in range(k, k + 10))]))
    assert b"again" in encoder.chunks and len(encoder.chunks) + len(encoder.chunks.young) + len(encoder.chunks.old) <= 60


def test_token_files_encode_columns(monkeypatch):
    from aerolith.llm import token_files

    encoder = token_files.shared_encoder(public_tokenizers.path(token_files.VOCABULARY))
    monkeypatch.setattr(encoder, "encode", None)
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(["so strange", None, "so"])], names=["doc_id", "text"])
    *found, _ = token_files._encode_pass(public_tokenizers.path(token_files.VOCABULARY), token_files.END)(iter([batch]))
    ids = [np.frombuffer(x, encoder.dtype).tolist() for x in found[0].column("ids").to_pylist()]
    assert ids == [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [token_files.END] for t in ("so strange", "", "so")]
