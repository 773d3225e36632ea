"""Quality classifier: features against plain ones, held-out labels of the driver's table, and defined cases."""

import os
import re

import numpy as np
import pytest

from junctura.llm import subwords as sw

SF = os.environ.get("TEST_SF_LABELS", "/root/testdata/sf0.01")
TEXTS = ["", " ", "a", "The the the  cat\nThe the the  cat\nno", "é😀 x\x0by" * 3, "word " * 50, "A" * 5000, "\x1c\x85 a\xa0b", "#### $$ go!!! go!!! stop"]


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain_grams(text):
    return sum(max(0, len(f" {w} ") - g + 1) for w in plain_words(text) for g in sw.GRAMS)


@pytest.mark.parametrize("text", TEXTS)
def test_features_of_whole_texts(text):
    own, words, again = sw.buckets(text)
    w = plain_words(text)
    assert words == len(w) and again == sum(a == b for a, b in zip(w, w[1:]))
    assert len(own) == len(w) + plain_grams(text) and (own < sw.BUCKETS - sum(sw.STEPS)).all()


def test_equal_words_fall_in_equal_buckets_wherever_they_stand():
    first = sw.buckets("one two")[0]
    moved = sw.buckets("   three one\ttwo")[0]
    assert set(first) <= set(moved) and len(set(first)) > 8


def test_parts_of_a_long_text_give_the_mean_of_the_whole(monkeypatch):
    text = "some words and\nothers in lines " * 400
    weights = np.random.default_rng(1).normal(size=sw.BUCKETS).astype(np.float32)
    whole = sw._mean(text, weights, 0.3)
    at, share = sw.counted(text, 0.3)
    monkeypatch.setattr(sw, "PART", 500)
    assert abs(sw._mean(text, weights, 0.3) - whole) < 1e-3 and abs(float(share @ weights[at]) - whole) < 1e-3
    assert "".join(sw.pieces(text)) == text and "".join(sw.pieces("x" * 2300)) == "x" * 2300


def test_pseudo_words():
    assert len({tuple(sw.steps(t, len(t.split()), 0)) for t in ("a b\nc d", "a b\na b", "a " * 400)}) == 3
    assert sw.steps("", 0, 0)[0] == sw.BUCKETS - sum(sw.STEPS) and max(sw.steps("a a\n" * 10**4, 20000, 19999)) < sw.BUCKETS


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = sw.op12_quality(spark, SF).collect()
    seen = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert np.mean([a == b for a, b in seen]) >= 0.95
    assert np.mean([a for a, b in seen if b == 0]) <= 0.2 and np.mean([a for a, b in seen if b == 1]) >= 0.98


def test_defined_cases(spark):
    schema = "doc_id long, text string, quality int, score string"
    docs = spark.createDataFrame([(1, "fine text here", 9, "x"), (2, None, 9, "x"), (2, None, 9, "x"), (3, "", 9, "x"), (None, "### ###", 9, "x"), (4, "z" * 3_000_000, 9, "x")], schema)
    labels = spark.createDataFrame([(1, 1), (3, 0), (1, 1), (None, 0), (4, None)], "doc_id long, quality int")
    model = sw.train(docs, labels)
    rows = sw.score(docs, model).collect()
    assert len(rows) == 6 and len({r.score for r in rows if r.doc_id == 2}) == 1
    assert sw.score(docs.limit(0), model).count() == 0
    one = sw.train(docs, labels.where("quality = 1"))
    assert {round(r.score, 6) for r in sw.score(docs, one).collect()} == {1.0}
    none = sw.train(docs, labels.limit(0))
    assert {round(r.score, 6) for r in sw.score(docs, none).collect()} == {0.0}
