"""The line model learns from all lines of a labelled text."""

from aerolith.llm import line_crf


def test_late_lines_are_learned_from(spark, monkeypatch):
    text = "\n".join(f"Plain line number {i} of some length." for i in range(450)) + "\n" + "\n".join(["All rights reserved | cookie"] * 30)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    seen = {}

    def fit(self, lines, gold):
        seen["gold"] = gold
        return self

    monkeypatch.setattr(line_crf.LineCrf, "fit", fit)
    line_crf.train(docs, labels)
    (gold,) = seen["gold"]
    assert len(gold) == 480 and sum(gold) == 29
