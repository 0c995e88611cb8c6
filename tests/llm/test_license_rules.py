"""License scans: ASCII lower-casing, long lists of detections, and a plain version of the rules."""

import re

import pytest

from aerolith.llm import licenses


def plain(text):
    """labels and score of a text: all matches of all rules, and suppression by comparing all pairs."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(licenses.SEPARATORS, lowered) if w]
    spaced = " " + "  ".join(words) + " "
    found = []
    for r in licenses.RULES:
        if not set(r["keywords"]) & set(words):
            continue
        for m in re.finditer(r["pattern"], spaced):
            s = spaced[: m.start()].count(" ") // 2
            found.append((s, s + m.group().count(" ") // 2, r["priority"], r["id"], r["label"], r["confidence"]))

    def better(a, b):
        return (a[2], a[0] - a[1], a[3]) < (b[2], b[0] - b[1], b[3])

    kept = [d for d in found if not any(o[0] <= d[0] and o[1] >= d[1] and better(o, d) for o in found)]
    labels = {d[4] for d in kept}
    for phrase, label in licenses.BASE:
        if f" {phrase} " in f" {' '.join(words)} ":
            labels.add(label)
    return ",".join(sorted(labels)), max((d[5] for d in kept), default=0.0)


TEXTS = [
    None,
    "",
    "no licence here",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "TOUS DROITS RÉSERVÉS",
    "Tous droits réservés",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    "GPL v3 or later. GNU GPL. MIT license. mit license version 2. cc-by-sa 4.0, CC BY 4.0",
    "SPDX-License-Identifier: MIT",
    "This work is licensed under a Creative Commons Attribution 4.0 license. All rights reserved. © 2021 x",
    "To the extent possible under law, the author has waived all copyright. In no event shall the author or anyone else be liable",
    " ".join(["mit license gpl 3 all rights reserved copyright 2020"] * 90),
]


def test_equals_a_plain_version(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in licenses.scan(docs).collect():
        assert (r["labels"], r["score"]) == plain(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]
    shouted, said = (next(r for r in licenses.scan(docs).collect() if r["doc_id"] == k) for k in (4, 5))
    assert shouted["labels"] == "" and said["labels"] == "reserved"


def test_blocks_equal_all_pairs(spark, monkeypatch):
    docs = spark.createDataFrame([(0, TEXTS[-1]), (1, TEXTS[-1] + " " + " ".join(t or "" for t in TEXTS[:-1]))], "doc_id long, text string")
    whole = [sorted(map(tuple, r["detections"])) for r in licenses.scan(docs).orderBy("doc_id").collect()]
    monkeypatch.setattr(licenses, "FEW", 10**6)
    assert whole == [sorted(map(tuple, r["detections"])) for r in licenses.scan(docs).orderBy("doc_id").collect()]


def test_rules_have_their_keywords_and_length():
    assert len(licenses.SIGNATURES) > 200
    for r in licenses.RULES:
        inner = r["pattern"].strip()
        assert all(re.fullmatch(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", k) for k in r["keywords"])
        most = len(re.split(r"  ", inner)) + 8 * inner.count("{")
        assert most < licenses.LONGEST
        assert re.compile(r["marking"]).groups == re.compile(r["pattern"]).groups + 1


@pytest.mark.parametrize("signature", licenses.SIGNATURES, ids=lambda s: s[1][:40])
def test_each_signature_contains_a_keyword(signature):
    """Every alternative of the expression has one of the keywords, by trying an example of each."""
    for example in examples(signature[1]):
        assert set(signature[2].split("|")) & set(example.split()), example


def examples(pattern):
    """Texts that an expression of groups, options and simple classes matches: each alternative at least once."""
    out = {""}
    tokens = re.findall(r"\((?:[^()]|\([^()]*\))*\)(?:\?|\{\d,\d\})?|\[[^\]]+\][*+]?\??|.\??", pattern)
    for t in tokens:
        optional = t.endswith("?")
        body = t[:-1] if optional else t
        if body.startswith("("):
            inner = re.sub(r"\{\d,\d\}$", "", body)[1:-1]
            depth, parts, last = 0, [], ""
            for c in inner:
                depth += (c == "(") - (c == ")")
                if c == "|" and depth == 0:
                    parts.append(last)
                    last = ""
                else:
                    last += c
            choices = [e for p in [*parts, last] for e in examples(p)]
        elif body.startswith("["):
            choices = ["x" if body.startswith("[^") else body[1]]
        else:
            choices = [body]
        out = {o + c for o in out for c in [*choices, *([""] if optional else [])]}
    return out
