"""Cases that each operator over documents defines: repeated rows, very long texts, empty tables, extra columns of clashing names."""

import numpy as np
import pytest

from junctura.llm import licenses, mixing, phrases, pieces, pii, quality, simhash, subwords

LONG = "alpha beta gamma, delta " * 30_000
TEXTS = ["the same text here, me@x.org", "the same text here, me@x.org", "", None, LONG, LONG]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, fp long, h long, f long, size long, kept boolean"


def documents(spark, texts=TEXTS):
    return spark.createDataFrame([(7 if i < 2 else i, t, "en", "s", 1, 0.5, "x", 1, 2, 3, 4, True) for i, t in enumerate(texts)], SCHEMA)


def scored(docs):
    model = {"weights": np.zeros(subwords.BUCKETS + 1, np.float32), "slope": 1.0, "offset": 0.0, "extra": 0.3}
    return subwords.score(docs, model)


#: Operator, and a column that equal rows must have alike.
CASES = {
    "pii": (pii.spans, "base"), "licenses": (licenses.scan, None), "simhash": (simhash.near_duplicates, "fp"), "quality": (quality.ledger, "n_words"),
    "pieces": (pieces.encode, None), "mixing": (mixing.mix, "size"), "subwords": (scored, "score"),
}


@pytest.mark.parametrize("name", CASES)
def test_each_row_gets_a_row_and_equal_rows_the_same(spark, name):
    run, column = CASES[name]
    rows = run(documents(spark)).collect()
    assert len(rows) == len(TEXTS)
    if column:
        own = [r[column] for r in rows if r["doc_id"] == 7]
        assert len(own) == 2 and own[0] == own[1]


@pytest.mark.parametrize("name", CASES)
def test_empty_tables(spark, name):
    assert CASES[name][0](documents(spark).limit(0)).count() == 0


def test_long_texts_count_whole(spark):
    rows = {r.doc_id: r for r in quality.ledger(documents(spark)).collect()}
    assert rows[4].n_words == 120_000 and rows[4].n_repeat_words == 120_000
    assert {r.doc_id: r["size"] for r in mixing.mix(documents(spark)).collect()}[5] == 120_000
    found = phrases.collocations(documents(spark, [LONG]), power=16).collect()
    assert {(r.phrase, r.a, r.n) for r in found} == {("alpha beta gamma", 30_000, 120_000), ("delta alpha beta", 29_999, 120_000)}
