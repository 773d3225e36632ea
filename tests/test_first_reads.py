"""Spanning reads: a key's first reads are enough, or all are looked at."""

import random

from junctura.operators import support as R


def test_first_reads_give_the_same_counts(spark):
    r = random.Random(1)
    names = {f"c{k}": r.choice([3, 5, 8, 40]) for k in range(40)}  # with few names, most keys' first reads are refused
    reads = []
    for c, n in names.items():
        reads += [(f"r{r.randrange(n)}", c, s := r.randrange(1, 8), s + r.randrange(20, 60), r.choice("+-"), r.random() < 0.9) for _ in range(250)]
    r.shuffle(reads)
    reads = [(i, *x) for i, x in enumerate(reads)]
    spans = [(c, a, a + r.randrange(0, 9)) for c in names for a in range(10, 60, 5)]
    want = {}
    for c, a, b in spans:
        keys, taken, some = set(), set(), False
        for _, name, contig, s, e, strand, whole in reads:
            if contig == c and whole and s <= a - 1 and e >= b + 1:
                some = True
                if (s, strand) not in keys and name not in taken:
                    keys.add((s, strand))
                    taken.add(name)
        if some:
            want[c, a, b] = len(keys)
    frame = spark.createDataFrame(reads, "seq_no long, name string, contig string, rstart long, rend long, strand string, whole boolean")
    asked = spark.createDataFrame(spans, "contig string, span1 long, span2 long")
    for layers in (1, 3):
        assert {(x.contig, x.span1, x.span2): x.spanning for x in R.spanning(asked, frame, layers=layers).collect()} == want
    assert R._first_reads(frame, 3).count() < len(reads)
