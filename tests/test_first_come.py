"""First-come pairing against the plain loop over all candidates."""

import random

import pytest

from junctura.operators import adjacency, graph


def plain_pairs(pairs, each_once):
    used, kept = set(), []
    for i in sorted({i for i, _ in pairs}):
        if i in used:
            continue
        for j in sorted(j for x, j in pairs if x == i):
            if j in used or (each_once and i in used):
                continue
            used.update((i, j))
            kept.append((i, j))
    return sorted(kept)


@pytest.mark.parametrize("each_once", [True, False])
def test_first_come_equals_the_plain_loop(spark, each_once):
    r = random.Random(3)
    pairs = sorted({(a, b) for a, b in ((r.randrange(120), r.randrange(120)) for _ in range(90)) if a != b})
    df = spark.createDataFrame([(i, j, i * 7) for i, j in pairs], "i bigint, j bigint, pos bigint")
    got = adjacency._first_come(df, each_once).collect()
    assert sorted((x.i, x.j) for x in got) == plain_pairs(pairs, each_once) and all(x.pos == x.i * 7 for x in got)
    assert adjacency._first_come(df.limit(0), each_once).count() == 0


def test_components_of_a_long_chain(spark):
    order = random.Random(1).sample(range(1000), 200)
    df = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(2000, 2001)], "a bigint, b bigint")
    got = {x.node: x.root for x in graph.components(df, "a", "b").collect()}
    assert got == {n: min(order) for n in order} | {2000: 2000, 2001: 2000}


def test_neighbours_pair_alike_in_bins_of_any_width(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(4)
    rows = [(i, f"chr{i % 3}", r.randrange(4000), r.choice("ab")) for i in range(900)]
    rows += [(900 + i, "chr9", 3 * i, "ab"[i % 2]) for i in range(700)]  # one run over all bins
    events = spark.createDataFrame(rows, "adj_id long, chrom1 string, break1 long, o string")
    want = []
    for chrom in sorted({x[1] for x in rows}):
        own, i = sorted((x for x in rows if x[1] == chrom), key=lambda x: (x[2], x[0])), 0
        while i + 1 < len(own):
            if own[i + 1][2] - own[i][2] <= 4 and own[i][3] != own[i + 1][3]:
                want.append((chrom, own[i][0], own[i + 1][0]))
                i += 2
            else:
                i += 1
    test = (F.col("next_break1") - F.col("break1") <= 4) & (F.col("next_o") != F.col("o"))
    for width in (7, 500, 10**9):
        assert sorted(map(tuple, adjacency.pair_neighbours(events, ["chrom1"], ["break1"], test, width=width).collect())) == sorted(want)
