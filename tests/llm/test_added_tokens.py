"""Ids against a fresh tokenizer of the library, with its defaults, for texts that hold the strings of added tokens."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aerolith.llm import packing, token_files
from aerolith.llm.tokenize import Encoder

PARTS = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>", "<", " ", "  ", "\n", "see", "É", "日本", "'s", "12", "!"]
TEXTS = ["see <|endoftext|> here", "<|startoftext|>a<|endoftext|>", "<|endoftext|>", "plain words", ""]


def fresh(name, text):
    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_a_fresh_tokenizer(name):
    encoder, rng = Encoder(public_tokenizers.path(name)), random.Random(7)
    library = Tokenizer.from_file(public_tokenizers.path(name))
    for text in TEXTS + ["".join(rng.choices(PARTS, k=rng.randint(1, 9))) for _ in range(2000)]:
        got = np.frombuffer(encoder.encode(text.encode()), encoder.dtype).tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, repr(text)


def checksum(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_operators_with_added_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    stored = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.write_and_read(docs).collect()}
    packed = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(docs).collect()}
    for i, text in enumerate(TEXTS):
        for got, name, end in ((stored, token_files.VOCABULARY, token_files.END), (packed, packing.VOCABULARY, packing.END)):
            ids = fresh(name, text) + [end]
            assert got[i] == (len(ids), checksum(ids))
