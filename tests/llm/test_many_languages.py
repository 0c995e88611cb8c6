"""Every lang value is learned, in as many blocks as it takes, with the same result as in one."""

import random

import pytest

from aerolith.llm import language_id


def test_more_languages_than_a_block(spark):
    rng, rows = random.Random(5), []
    for k in range(70):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(12)]
        rows += [(10 * k + i, " ".join(rng.choices(words, k=25)), f"l{k:02}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    one = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    many = {r["doc_id"]: r for r in language_id.identify(docs, block_cells=1_500_000).collect()}
    assert {r["lang_pred"] for r in one.values()} == {lang for *_, lang in rows}
    for doc_id, _, lang in rows:
        assert one[doc_id]["lang_pred"] == many[doc_id]["lang_pred"] == lang
        assert one[doc_id]["score"] == pytest.approx(many[doc_id]["score"])
