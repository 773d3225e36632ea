"""Chimeric contigs: chains against enumeration, doubts on made-up alignments, and contigs with very many chains."""

import itertools
import random
import time

from junctura.operators import chimeras as X
from junctura.plans import genome

NODE = "query string, seg_id long, query_len int, target string, qstart long, qend long, tstart long, edits long"


def follows(a, b):
    shorter = min(a[5] - a[4], b[5] - b[4]) + 1
    return b[4] > a[4] and b[5] > a[5] and max(0, a[5] - b[4] + 1) / shorter < 0.2 and max(0, b[4] - a[5] - 1) / shorter < 0.2


def chains(rows, edge=0.02):
    """All chains of one contig from end to end."""
    k = max(1, int(rows[0][2] * edge)) if rows else 1
    open_ = [[r] for r in rows if r[4] <= k]
    out = []
    while open_:
        path = open_.pop()
        if path[-1][5] >= rows[0][2] - k + 1:
            out.append(path)
        open_ += [[*path, r] for r in rows if follows(path[-1], r)]
    return out


def value(path):
    return len({p for r in path for p in range(r[4], r[5] + 1)}), -sum(r[7] for r in path)


def drawn(seed, n):
    r = random.Random(seed)
    out = []
    for c in range(n):
        ends = sorted(r.sample(range(20, 181, 20), r.randrange(1, 4)))
        for i, (a, b) in enumerate(itertools.pairwise([0, *ends, 200])):
            for k in range(r.randrange(1, 4)):
                out.append((f"c{c}", 10 * i + k, 200, r.choice(["1", "2", "1_alt"]), max(1, a + 1 + r.randrange(-3, 4)), min(200, b + r.randrange(-3, 4)), 1000 * r.randrange(2000), r.randrange(4)))
    return out


def test_chains_equal_enumeration(spark):
    rows = drawn(1, 60)
    got = {r["query"]: (r["covered"], -r["edits"]) for r in X.end_to_end(spark.createDataFrame(rows, NODE)).collect()}
    want = {}
    for q, own in itertools.groupby(rows, lambda r: r[0]):
        if found := chains(list(own)):
            want[q] = max(map(value, found))
    assert got == want and len(want) > 10


def test_doubts_equal_enumeration(spark):
    rows = drawn(2, 80)
    members, others = [r for r in rows if r[1] % 10 == 0], [r for r in rows if r[1] % 10]
    df = lambda x: spark.createDataFrame(x, NODE)
    by = lambda x, q: [r for r in x if r[0] == q]
    doubt, lost = set(), set()
    for q in {r[0] for r in members}:
        for m in by(members, q):
            if chains([r for r in by(rows, q) if r[1] != m[1]]):
                doubt.add((q, m[1]))
        if any(value(p) >= value(by(members, q)) for p in chains(by(others, q))):
            lost.add(q)
    assert {tuple(r) for r in X.replaceable(df(members), df(others)).collect()} == doubt and doubt
    assert {r[0] for r in X.outdone(df(members), df(others)).collect()} == lost and lost


def test_pairs_on_one_target_replace_a_translocation(spark):
    rows = [("a", 1, 200, "1", 1, 100, 500, 0), ("a", 2, 200, "2", 101, 200, 900, 0), ("b", 1, 200, "1", 1, 100, 500, 0), ("b", 2, 200, "1", 101, 200, 900, 0), ("c", 1, 200, "1", 1, 100, 5, 0), ("c", 2, 200, "2", 101, 200, 9, 0)]
    others = [("a", 3, 200, "1", 101, 200, 90000, 2), ("a", 4, 200, "1", 101, 199, 700, 2), ("a", 5, 200, "2", 1, 100, 901, 2), ("c", 3, 200, "1", 101, 200, 2_000_000, 0), ("c", 4, 200, "2", 1, 99, 1_000_009, 0)]
    m, o = spark.createDataFrame(rows, NODE), spark.createDataFrame(others, NODE)
    swaps = X.same_target(m, o)
    assert [tuple(r) for r in swaps.collect()] == [("a", 1, 4, 200)]
    assert sorted((r["query"], r.seg_id) for r in X.swapped(m, o, swaps).collect()) == [("a", 1), ("a", 4), ("b", 1), ("b", 2), ("c", 1), ("c", 2)]


def test_very_many_chains_are_not_enumerated(spark):
    rows = [("q", 2 * i + k, 2000, f"t{k}", 100 * i + 1, 100 * (i + 1) + 3 * k * (i < 19), i, k) for i in range(20) for k in (0, 1)]
    began = time.time()
    assert [tuple(r) for r in X.end_to_end(spark.createDataFrame(rows, NODE)).collect()] == [("q", 2000, 0)]
    assert time.time() - began < 60


ALIGNED = "seq_no bigint, query string, flag int, target string, pos bigint, mapq int, cigar array<struct<op: string, len: int>>, mate_target string, mate_pos bigint, tlen int, seq string, nm int"


def aligned(spark, rows):
    parts = lambda text: [(op, int(n)) for n, op in __import__("re").findall(r"(\d+)([MSHID])", text)]
    return spark.createDataFrame([(i, q, flag, t, pos, 60, parts(c), None, None, 0, "A" * 200, nm) for i, (q, flag, t, pos, c, nm) in enumerate(rows)], ALIGNED)


def test_genome_plan_marks_doubt_and_leaves_contigs_out(spark):
    rows = [
        ("plain", 0, "chr1", 1000, "100M100S", 0), ("plain", 2048, "chr1", 9000, "100H100M", 0),
        ("doubt", 0, "chr1", 1000, "100M100S", 0), ("doubt", 2048, "chr1", 9000, "100H100M", 0), ("doubt", 256, "chr5", 77, "100H100M", 3),
        ("beaten", 0, "chr1", 1000, "100M100S", 2), ("beaten", 2048, "chr1", 9000, "98M102S", 0), ("beaten", 2048, "chr1", 9000, "100H100M", 2), ("beaten", 256, "chr3", 7, "100M100S", 0), ("beaten", 256, "chr3", 900, "100H100M", 0),
        ("hidden", 0, "chr1", 1000, "100M100S", 0), ("hidden", 2048, "chr1", 9000, "100H100M", 0),
    ]
    contigs = spark.createDataFrame([(q, "ACGTACTTGA" * 20) for q in ("plain", "doubt", "beaten", "hidden")] + [("short", "ACGT")], "name string, seq string")
    skip = spark.createDataFrame([("hidden",)], "name string")
    found = genome.events(aligned(spark, rows), contigs, skip=skip, least_contig=100)
    assert {(r["query"], r.rearrangement, r.dubious) for r in found.collect()} == {("plain", "del", False), ("doubt", "del", True)}
    off = genome.events(aligned(spark, rows), contigs, skip=skip, check_alternatives=False)
    assert {(r["query"], r.dubious) for r in off.collect()} == {("plain", False), ("doubt", False)}
    assert genome.events(aligned(spark, rows), contigs, least_contig=201).isEmpty()
