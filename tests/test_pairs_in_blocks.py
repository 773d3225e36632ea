"""First-come pairing in blocks of takers: small blocks and short lists of candidates give what the plain loop gives."""

import random

import pytest
from pyspark.sql import functions as F
from test_first_come import plain_pairs

from junctura.operators import adjacency


@pytest.mark.parametrize("each_once", [True, False])
def test_blocks_that_stop_early_equal_the_plain_loop(spark, each_once):
    r = random.Random(8)
    pairs = sorted({(a, b) for a, b in ((r.randrange(12), r.randrange(12)) for _ in range(60)) if a != b})
    known = spark.createDataFrame(pairs, "i bigint, j bigint").coalesce(1).cache()
    nodes = spark.range(12).select("id", F.col("id").alias("own")).coalesce(1)

    def find(takers, free):
        return known.join(takers.select(F.col("id").alias("i"), F.col("own").alias("x")), "i").join(free.select(F.col("id").alias("j"), F.col("own").alias("y")), "j").select("i", "j", "x", "y")

    for block, most in ((6, 1), (40, 40)):
        got = adjacency._in_turn(nodes, find, each_once, [], block=block, most=most)
        assert sorted((x.i, x.j) for x in got.collect()) == plain_pairs(pairs, each_once)


def test_no_list_of_all_pairs_is_written(spark, monkeypatch):
    """800 breaks at one place have 160,000 candidate pairs; what is written stays of the order of the breaks."""
    events = spark.createDataFrame([(n, f"c{n}", "chr1", 1000, "LR"[n % 2], "chr2" if n % 4 < 2 else "chr3", 5 * n, "L", 900, 1000, 1, 2) for n in range(800)], "adj_id long, contig string, chrom1 string, break1 long, orient1 string, chrom2 string, break2 long, orient2 string, span1_start long, span1_end long, span2_start long, span2_end long")
    sizes, real = [], adjacency.cut
    monkeypatch.setattr(adjacency, "cut", lambda df: (out := real(df), sizes.append(out.count()))[0])
    got = adjacency.imprecise_insertions(events).collect()
    assert len({c for x in got for c in (x.adj1, x.adj2)}) == 2 * len(got) > 700 and max(sizes) <= 1600
