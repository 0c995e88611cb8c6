"""Signatures travel as five bytes, and what runs in a workspace gives its shuffle files up as it ends."""

import glob

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from aerolith.llm import common, jaccard_join


class _Shared:
    value = np.zeros(0, np.uint64)


def test_signatures_take_five_bytes_and_keep_their_buckets():
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-3]), " ".join(f"x{i}" for i in range(400)), "a b c d e f g h", "a b c d e f g h i"]
    sent = list(jaccard_join._signature_pass(4, _Shared)(iter([pa.record_batch([pa.array(texts)], names=["text"])])))
    made, classes = {}, [jaccard_join.shingles(t.encode(), jaccard_join._Words()) for t in texts]
    for found in classes:
        for s in jaccard_join.signatures(found, _Shared.value).tolist():
            made.setdefault(s, set()).add(jaccard_join.class_key(found))
    rows = [r for b in sent for r in b.to_pylist()]
    assert sum(len(r["sigs"]) for r in rows) == 5 * sum(len(jaccard_join.signatures(f, _Shared.value)) for f in classes)
    together = set()
    for part in {r["part"] for r in rows}:
        own = pa.RecordBatch.from_pylist([r for r in rows if r["part"] == part], sent[0].schema)
        buckets = {}
        for b in jaccard_join._bucket_pass(iter([own])):
            for r in b.to_pylist():
                buckets.setdefault(r["bucket"], set()).add(r["key"])
        together |= {frozenset(x) for x in buckets.values()}
    assert together == {frozenset(x) for x in made.values() if len(x) > 1} and len(together) >= 2


def test_bits_survive_packing():
    part, sigs = jaccard_join._dealt(np.array([0, 1, (1 << 64) - 1, 1 << 40, 0x123456789ABCDEF0], np.uint64), 3)
    assert part.max() < 3 and jaccard_join._unpacked(jaccard_join._packed(sigs)).tolist() == sigs.tolist()


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    names = {r["key"]: r["value"] for r in spark.sql("SET -v").select("key", "value").collect()}
    before = spark.conf.get(common.SHUFFLES_END, "false")
    held = lambda: set(glob.glob(f"{folder}/**/shuffle_*.data", recursive=True))
    folder = str(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0])
    assert common.SHUFFLES_END in names
    earlier = held()
    with common.workspace(spark):
        common.spill(spark.range(100_000).repartition(3, "id").groupBy((F.col("id") % 1000).alias("k")).count(), "some")
        assert spark.conf.get(common.SHUFFLES_END) == "true"
    assert not held() - earlier
    assert spark.conf.get(common.SHUFFLES_END, "false") == before
