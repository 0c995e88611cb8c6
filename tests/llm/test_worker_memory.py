"""What a Python worker holds at once and keeps between tasks."""

import public_tokenizers
import pytest

from aerolith.llm import common, exact_dedup, jaccard_join, language_id, packing, token_files
from aerolith.llm.tokenize import Encoder, shared_encoder

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_token_files_are_written_in_small_batches(spark, monkeypatch):
    found, before = {}, spark.conf.get(ROWS)

    def seen(name, make):
        def run(*args):
            inner = make(*args)

            def sizes(batches):
                def checked():
                    for batch in batches:
                        assert batch.num_rows <= token_files.TEXT_ROWS, name
                        yield batch

                yield from inner(checked())

            found[name] = True
            return sizes

        return run

    for name in ("_encode_pass", "_segment_pass"):
        monkeypatch.setattr(token_files, name, seen(name, getattr(token_files, name)))
    docs = spark.range(2500).selectExpr("id as doc_id", "concat('word ', id) as text").coalesce(1)
    path = common.scratch(spark, "tokens")
    token_files.write(docs, path)
    assert token_files.read(spark, path).count() == 2500 and len(found) == 2 and spark.conf.get(ROWS) == before
    common.discard(spark, path)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_a_word_is_remembered_once_whatever_mark_follows(name):
    encoder = Encoder(public_tokenizers.path(name))
    text = "so strange, strange. strange! über, über; élan."
    assert encoder.encode(text.encode()) == encoder.whole(text)
    assert not any("strange" in piece or "ber" in piece for piece in encoder.pieces)


@pytest.mark.parametrize("following", [language_id._gram_pass, language_id._block_pass(None, True, ["a", "b", "c"]), exact_dedup._digest_pass(10), jaccard_join._class_pass])
def test_encoders_go_when_other_operators_use_the_worker(following):
    shared_encoder(public_tokenizers.path(packing.VOCABULARY)).encode(b"some words")
    assert shared_encoder.cache_info().currsize
    list(following(iter([])))
    assert not shared_encoder.cache_info().currsize


def test_digests_are_made_in_small_batches(spark, monkeypatch):
    inner, most = exact_dedup._digest_pass, exact_dedup.TEXT_ROWS

    def checked(counters):
        def run(batches):
            def small():
                for batch in batches:
                    assert batch.num_rows <= most
                    yield batch

            yield from inner(counters)(small())

        return run

    monkeypatch.setattr(exact_dedup, "_digest_pass", checked)
    docs = spark.range(2500).selectExpr("id as doc_id", "concat('word ', id) as text").coalesce(1)
    assert exact_dedup.keep_winners(docs).count() == 2500
