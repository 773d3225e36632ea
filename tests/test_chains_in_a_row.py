"""The best chain from end to end: contigs in a row each, and in rounds of joins."""

import random

from junctura.operators import chimeras as X


def test_rows_equal_rounds(spark, monkeypatch):
    r = random.Random(3)
    rows = []
    for q in range(150):
        for k in range(r.randrange(1, 10)):
            s = r.choice([1, 1, 90, 100, 101, 105, 190, 200, 201])
            rows.append((f"q{q}", q * 100 + k, 300, "chr1", s, min(300, s + r.choice([90, 99, 100, 110, 199])), 1, r.choice([None, 0, 1, 2])))
    nodes = spark.createDataFrame(rows, "query string, seg_id long, query_len int, target string, qstart long, qend long, tstart long, edits long")
    in_rounds = sorted(map(tuple, X.end_to_end(nodes, in_row=0).collect()))
    mixed = sorted(map(tuple, X.end_to_end(nodes, in_row=5).collect()))
    assert len(in_rounds) > 20 and mixed == in_rounds
    monkeypatch.setattr(X, "edges", None)  # contigs of few segments need no joins
    assert sorted(map(tuple, X.end_to_end(nodes).collect())) == in_rounds
