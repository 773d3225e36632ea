"""SimHash, nearest neighbours, mixing: against plain versions."""

import random
import re

import numpy as np
import pytest
import xxhash

from junctura.llm import ann, mixing, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, size long"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "k", 3) for i, t, s in rows], DOCS)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, most=4):
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d is None, d or 0, "%016x" % f, least.get(find(i), -1)) for i, ((d, _, _), f) in enumerate(zip(rows, fps, strict=True)))


def corpus():
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choice(words) for _ in range(200)) for _ in range(12)]
    rows = []
    for n in range(90):
        w = base[n % 12].split()
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((n * 3 % 97, " ".join(w), "s"))
    return rows + [(200, None, None), (201, "", "s"), (202, " \t\n", "s"), (203, "one two", "s"), (203, "one two", "s"), (None, base[0], "s"), (None, "only here", None), (204, "ONE TWO", "s")]


def test_components_equal_plain_ones(spark):
    rows = corpus()
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, "%016x" % (r.fp % 2**64), r.component_id if r.component_id is not None else -1) for r in got) == plain_components(rows)


def test_cells_split_hot_keys_without_losing_links(spark):
    r = random.Random(5)
    fps = sorted({int(np.int64(np.uint64(sum(1 << b for b in r.sample(range(16), 5))))) for _ in range(300)})
    classes = spark.createDataFrame([(f,) for f in fps], "fp long")

    def roots(cell):
        return sorted((x.node, x.root) for x in simhash.components(simhash.links(classes, cell=cell)).collect())

    assert roots(20) == roots(4096)


def test_one_of_each_keeps_columns_and_one_row(spark):
    rows = corpus()
    kept = simhash.one_of_each(docs(spark, rows))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    want = len({r[3] for r in plain_components(rows) if r[3] != -1})
    ids = [r.doc_id for r in kept.collect()]
    assert len([i for i in ids if i is not None]) == len(set(ids) - {None}) == want
    assert ids.count(None) == 1  # the component of null ids only


def test_empty_table(spark):
    none = docs(spark, [])
    assert simhash.near_duplicates(none).count() == simhash.one_of_each(none).count() == mixing.mix(none).count() == mixing.mixture(none).count() == 0


def plain_nearest(rows, k):
    good = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append((i, np.array(v, np.float64)))
    out = []
    for q, a in {(i, tuple(v)): (i, v) for i, v in good if i % 20 == 0}.values():
        found = sorted((-float(sum(x * y for x, y in zip(a, b, strict=True))), i) for i, b in {(i, tuple(v)): (i, v) for i, v in good}.values() if i != q and len(a) == len(b))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 2048), (40, 3)])
def test_nearest_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(200)]
    hot = rows[7][1]
    rows += [(i, hot) for i in range(200, 260)]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0] * 7 + [float("nan")]), (304, [1.0] * 7 + [float("inf")]), (305, [1.0] * 7 + [None]), (320, [1.0, 2.0]), (321, [2.0, 1.0]), (None, hot)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, id long, dim int")
    got = sorted(tuple(r) for r in ann.nearest(df, lambda i: i % 20 == 0, k=20, candidates=blocks[0], per_query_block=blocks[1]).collect())
    want = plain_nearest([(i, v) for i, v in rows], 20)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want, strict=True))


def test_nearest_of_nothing(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 20 == 0).count() == 0


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randrange(1, 40)), r.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(700, None, "a"), (701, "", "b"), (702, "x y", "a"), (702, "x y", "a")]
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals, taken, target = {}, {}, {}
    for x in got:
        totals[x.source] = totals.get(x.source, 0) + x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
        target[x.source] = x.target
        assert x.taken in (0, x.size, 2 * x.size) and x.source_size == sum(size(t) for _, t, s in rows if s == x.source)
    # The plain resharing: give by weight, cap, share the excess again.
    names = sorted((s for s in totals if s is not None)) + [None]
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    left, capped = 1.5 * sum(totals.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        level = (left - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * totals[s]]
        if not over:
            break
        capped |= {s: 2.0 * totals[s] for s in over}
    want = capped | {s: level * weight[s] for s in names if s not in capped}
    assert all(abs(want[s] - target[s]) < 1e-6 and abs(taken[s] - target[s]) <= 80 for s in names)
    again = sorted((x.doc_id, x.size, x.nth, x.taken) for x in mixing.mix(df.repartition(5)).collect())
    assert again == sorted((x.doc_id, x.size, x.nth, x.taken) for x in got)
    out = mixing.mixture(df)
    assert out.columns == df.columns and out.count() == sum(x.epochs for x in got)
