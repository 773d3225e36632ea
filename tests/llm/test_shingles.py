"""Near-duplicates of the pipeline against plain sets of shingles."""

import random


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    sets, group = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def test_edited_copies_go(spark):
    import corpus_pipeline

    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for n in range(12):
        base = [r.choice(words) for _ in range(r.choice([60, 200, 700]))]
        for edits in (0, 1, 2, 3, 5, 8, 13):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((len(rows), " ".join(w)))
    rows += [(500, None), (501, ""), (502, "one two"), (503, "ONE  two"), (504, "one two three")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    group = plain_components(rows)
    got = sorted(x.doc_id for x in corpus_pipeline.distinct(spark, docs, "").collect())
    assert got == [rows[g][0] for g in sorted(set(group))] and 12 < len(got) < len(rows) - 24


def test_cells_of_a_component_lose_no_link(spark):
    from junctura.llm import shingles

    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows, w = [], [r.choice(words) for _ in range(120)]
    for n in range(60):  # a chain: each text a few edits from the one before
        w = list(w)
        for _ in range(2):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((n, " ".join(w)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(0, rows[0][1], "y")], "doc_id long, text string, root string")

    def groups(**how):
        return sorted((x.doc_id, x.component_id) for x in shingles.near_duplicates(docs, **how).collect())

    want = sorted([(i, g) for i, g in enumerate(plain_components(rows))] + [(0, 0)])
    assert groups() == want == groups(cell=500)
    assert shingles.one_of_each(docs.limit(0)).count() == 0


def test_similar_sets_of_all_sizes_share_a_block():
    import numpy as np

    from junctura.llm import shingles

    rng = np.random.default_rng(2)
    for n in (4, 5, 6, 7, 9, 12, 15, 20, 33, 64, 100, 257, 1000, 5000):
        for _ in range(60 if n < 300 else 10):
            both = rng.integers(0, 2**63, n, np.uint64)
            spare = int(n * 0.25)  # of a union of n + spare, n are shared: similarity 0.8 at least
            left = rng.integers(0, spare + 1)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, k, np.uint64)])) for k in (left, spare - left))
            assert set(shingles.block_keys(a)) & set(shingles.block_keys(b))
            assert sum((x ^ y).bit_count() if (x < 0) == (y < 0) else ((x ^ y) % 2**64).bit_count() for x, y in zip(shingles.fingerprint_of(a), shingles.fingerprint_of(b), strict=True)) <= shingles.FAR
