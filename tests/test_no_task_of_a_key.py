"""Steps whose work on one key, chromosome or null key is cut into tasks."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from junctura.operators import adjacency as A
from junctura.operators import intervals as I
from junctura.operators import splice as P


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def as_dealt(spark):
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("false", "-1", "4"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_events_without_a_link_are_spread(spark, as_dealt):
    events = spark.range(4000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).alias("link_id"), F.when(F.col("id") == 10, 1).otherwise(5).alias("spanning"))
    kept = P.supported(events).withColumn("part", F.spark_partition_id())
    assert kept.count() == 3999
    assert kept.groupBy("part").count().agg(F.max("count")).first()[0] < 2000


def random_spans(n, seed, most=4000, wide=300):
    r = random.Random(seed)
    return [(i, r.choice(["c1", "c2", "c3"]), s := r.randrange(1, most), s + r.randrange(-3, wide)) for i in range(n)]


def test_union_length_has_no_window_over_a_key(spark):
    for n in (5, 200):
        spans = random_spans(n, n)
        found = I.union_length(spark.createDataFrame(spans, "id long, c string, s long, e long"), ["c"], "s", "e", width=100)
        assert "Window" not in plan(found)
        want = {}
        for _, c, s, e in spans:
            want.setdefault(c, [set(), s, e])
            want[c] = [want[c][0] | set(range(s, e + 1)), min(want[c][1], s), max(want[c][2], e)]
        assert {x.c: [x.covered, x["first"], x["last"]] for x in found.collect()} == {c: [len(p), a, b] for c, (p, a, b) in want.items()}


def test_without_overlap_makes_no_pairs(spark):
    left, right = random_spans(60, 1), random_spans(40, 2)
    a, b = spark.createDataFrame(left, "id long, c string, s long, e long"), spark.createDataFrame(right, "rid long, rc string, rs long, re long")
    found = I.without_overlap(a, b, [("c", "rc")], ("s", "e"), ("rs", "re"), ["id"], width=100)
    hit = {i for i, c, s, e in left for _, d, t, f in right if c == d and max(s, t) <= min(e, f)}
    assert {x.id for x in found.collect()} == {i for i, *_ in left} - hit
    assert "collect_list" in plan(found)  # of each bin one row


def test_neighbours_in_places_equal_neighbours_in_bins(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["c1", "c2"]), r.randrange(1, 60), r.choice("LR")) for i in range(400)]
    events = spark.createDataFrame(rows, "adj_id long, chrom1 string, break1 long, o string")
    test = (F.col("next_break1") - F.col("break1") <= 1) & (F.col("o") != F.col("next_o"))
    pairs = lambda **k: {tuple(x) for x in A.pair_neighbours(events, ["chrom1"], ["break1"], test, **k).collect()}
    want = pairs()
    assert want and pairs(most=7) == want and pairs(most=40, width=20) == want


def test_places_have_the_ids_of_merged_events(spark):
    r = random.Random(6)
    rows = [(i, str(i), r.choice(["del", "trl"]), "c1", r.randrange(9), "L", "c2", r.randrange(9), "R", 1, 2) for i in range(200)]
    events = spark.createDataFrame(rows, "seq_no long, query string, rearrangement string, chrom1 string, break1 long, orient1 string, chrom2 string, break2 long, orient2 string, cb1 long, cb2 long")
    cols = ["adj_id", *A.KEY]
    assert sorted(A.places(events).select(cols).collect()) == sorted(A.merge(events).select(cols).collect())
