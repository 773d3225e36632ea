"""Insertions of a piece between two breaks need no turns: each second takes the smallest id. The turns of imprecise insertions get numbers alone."""

import random

import pytest

from junctura.operators import adjacency

COLUMNS = "adj_id long, contig string, chrom1 string, break1 long, orient1 string, chrom2 string, break2 long, orient2 string, span1_start long, span1_end long, span2_start long, span2_end long, dubious boolean"


def _events(n):
    r = random.Random(5)
    ids, out = r.sample(range(10 * n), n), []
    for k in ids:
        ends = []
        for _ in range(2):
            at, o = r.randrange(60), r.choice("LR")
            span = (at, at + r.randrange(40)) if o == "R" else (at - r.randrange(40), at)
            ends.append((r.choice(["chr1", "chr2"]), at if r.random() < 0.9 else at + 1, o, r.choice([span, span[::-1], (None, span[1])])))
        (c1, b1, o1, s1), (c2, b2, o2, s2) = ends
        out.append((k, f"c{k}", c1, b1, o1, c2, b2, o2, *s1, *s2, r.random() < 0.1))
    return out


def _plain(events, first, most):
    """The plain loop: ids in turn, each with every free partner in the order of ids."""
    names = COLUMNS.replace(",", "").split()[::2]
    rows = sorted((dict(zip(names, e, strict=True)) for e in events if not e[-1]), key=lambda e: e["adj_id"])
    t, s = ("1", "2") if first else ("2", "1")
    used, out = set(), []
    for a in rows:
        if a["adj_id"] in used:
            continue
        for b in rows:
            if a is b or b["adj_id"] in used or any(a[c + k] != b[c + k] for c, k in (("chrom", t), ("chrom", s))):
                continue
            if abs(a["break" + t] - b["break" + t]) > most or a["orient" + t] == b["orient" + t]:
                continue
            ends = [x for e in (a, b) for x in (e[f"span{s}_start"], e[f"span{s}_end"]) if x is not None]
            x, y, o = a["break" + s], b["break" + s], a["orient" + s] + b["orient" + s]
            if x == min(ends) and y == max(ends) and ((o == "LR" and y < x) or (o == "RL" and x < y)):
                used |= {a["adj_id"], b["adj_id"]}
                out.append((a["adj_id"], b["adj_id"], a["chrom" + t], a["break" + t], b["break" + t], abs(x - y) + 1))
    return sorted(out)


@pytest.mark.parametrize("first", [True, False])
def test_insertions_between_take_no_turns(spark, monkeypatch, first):
    monkeypatch.setattr(adjacency, "_in_turn", None)
    events = _events(160)
    got = sorted(map(tuple, adjacency.insertions_between(spark.createDataFrame(events, COLUMNS), first, 20).collect()))
    assert got == _plain(events, first, 20) and len(got) > 10 and len({x[0] for x in got}) < len(got)


def test_turns_of_imprecise_insertions_get_numbers(spark, monkeypatch):
    seen, real = [], adjacency._in_turn

    def spy(nodes, find, *args, **more):
        seen.extend(f.dataType.simpleString() for f in find(nodes, nodes).schema)
        return real(nodes, find, *args, **more)

    monkeypatch.setattr(adjacency, "_in_turn", spy)
    events = spark.createDataFrame([(1, "c1", "chr1", 100, "L", "chr2", 5, "R", 1, 9, 1, 9, False), (2, "c2", "chr1", 130, "R", "chr3", 5, "R", 1, 9, 1, 9, False)], COLUMNS)
    assert list(map(tuple, adjacency.imprecise_insertions(events).collect())) == [(1, 2, 1, 1, "chr1", 100, 130, None)]
    assert set(seen) == {"bigint", "int"}
