"""Vector codes: against plain Lloyd rounds with full scans in Python integers."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from junctura.llm import codebooks as cb

SCHEMA = "vec_id long, embedding array<double>, label string, code string, v long"


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, label, code, error) of kept rows of the first length, and the codebooks."""
    kept = [(i, [math.floor(4096 * c) for c in v], lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    d = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == d]
    at = [p * d // parts for p in range(parts + 1)]
    out, books = [["", 0] for _ in kept], []
    for p in range(parts):
        x = [r[1][at[p] : at[p + 1]] for r in kept]
        book = [list(v) for v in x[:entries]]
        near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))
        for _ in range(rounds):
            own = [near(v, book)[1] for v in x]
            for e in range(len(book)):
                if mine := [v for v, o in zip(x, own, strict=True) if o == e]:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        for o, v in zip(out, x, strict=True):
            dist, e = near(v, book)
            o[0] += f"{e:02x}"
            o[1] += dist
        books.append(book)
    return sorted((str((r[0], r[2])), c, e if e < 1 << 63 else None) for r, (c, e) in zip(kept, out, strict=True)), books


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], SCHEMA).repartition(3)


def drawn(n, d=16, seed=1, scale=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(d)] for _ in range(5)]
    return [(7 * i % 101 + 101 * (i // 101), [float(np.float32(scale * (c + r.gauss(0, 0.3)))) for c in r.choice(centres)], r.choice(["a", "b", None])) for i in range(n)]


CASES = {
    "drawn": drawn(400),
    "ties and repeated rows": [(i % 9, [float((i * k) % 3) for k in range(8)], "a") for i in range(60)],
    "fewer rows than entries": drawn(5),
    "no part of its own": [(i, [float(i % 4), 0.5, -1.25], None) for i in range(40)],
    "huge": drawn(40, scale=1e30) + [(900, [3e38] * 16, "a"), (901, [-3e38] * 16, "a")],
    "left out": [*drawn(30), (None, [0.25] * 16, "n"), (1000, None, "a"), (1001, [None] + [0.0] * 15, "a"), (1002, [math.nan] * 16, "a"), (1003, [math.inf] * 16, "a")],
}


@pytest.mark.parametrize("case", CASES)
def test_codes_equal_full_scans(spark, case):
    coded, books = cb.compress(vectors(spark, CASES[case]))
    want, plain_books = plain(CASES[case])
    assert sorted((str((r.vec_id, r.label)), r.code, r.error) for r in coded.collect()) == want
    assert books == plain_books


def test_other_lengths_and_empty_tables(spark):
    coded, _ = cb.compress(vectors(spark, [*drawn(20), (500, [1.0], "a"), (501, [], "b")]))
    assert {r.vec_id: (r.code, r.error) for r in coded.collect() if r.vec_id in (500, 501)} == {500: (None, None), 501: (None, None)} and coded.count() == 22
    empty, books = cb.compress(vectors(spark, drawn(1)).limit(0))
    assert empty.count() == 0 and books == [] and empty.columns == ["vec_id", "label", "code", "error"]


def test_bounds_spare_distances_and_change_nothing():
    x = cb.integers(np.array([v for _, v, _ in drawn(3000, d=8)]))
    book = x[:16].copy()
    group, state, moved, made = cb.grouped(book, 4), None, None, []
    for _ in range(8):
        *state, n = cb.assign(x, book, group, state and tuple(state), moved)
        full = cb.distances(x, book)
        assert (state[0] == full.argmin(1)).all()
        left = full.astype(float) ** 0.5
        assert (state[1] >= left[np.arange(len(x)), state[0]]).all()
        left[np.arange(len(x)), state[0]] = np.inf
        assert all((state[2][:, g] <= left[:, group == g].min(1)).all() for g in range(group.max() + 1))
        made.append(n)
        totals = [int(v) for v in cb.sums_of(x, state[0], 16).ravel()]
        (book,), (moved,) = cb.moved_to([book], totals)
    assert made[-1] < 0.5 * made[0]


def test_sums_in_limbs():
    for v in (0, 5, -1, 1 << 200, -(1 << 200), -(3**50)):
        assert sum(x << (cb.LIMB * k) for k, x in enumerate(cb.limbs(v))) == v and all(x >= 0 for x in cb.limbs(v)[:-1])


def test_query_equals_sql(spark, tmp_path):
    rows = [(i, v, lab) for n, (i, v, lab) in enumerate(drawn(300)) if n]
    vectors(spark, rows).selectExpr("vec_id", "cast(embedding as array<float>) embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, cb.op11_vector_codes(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.sql(cb.sql()).fetchall())
    books = plain(rows)[1]
    assert got[0][4] == hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
