"""Phrase collocations: against a plain count in Python, and the perfect hash by its properties."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from junctura.llm import phrases as ph

SCHEMA = "doc_id long, text string, lang string, phrase string, n long"


def plain(rows, longest=3, least=10, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {p: n for p, n in f.items() if len(p) > 2 and n >= least}
    most = Counter()
    for p, n in often.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                most[(p[0], *p[i : i + k])] = max(most[(p[0], *p[i : i + k])], n)
    out = []
    for p, a in often.items():
        if 100 * most[p] >= 50 * a:
            continue
        cuts = [(10**6 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1)]
        score, _, left, right = min(cuts)
        out.append((p[0], -score, -a, " ".join(p[1:]).encode(), left, right))
    nth, found = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        nth[lang] += 1
        if nth[lang] <= top:
            found.append((lang, nth[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return found


def texts(n=300, seed=5):
    r = random.Random(seed)
    words = ["Hot", "a", "b", "cé", "É", "d#", "x\x1cy", "long-word", "😀"]
    rows = [(" ".join(r.choices(words, [9, 5, 4, 3, 2, 2, 1, 1, 1], k=r.randrange(1, 60))).replace("b a", r.choice(["b. a", "b\ta", "b\ra", "B A", "b  a"])), r.choice(["en", "en", "en", "de", None, "und", ""])) for _ in range(n)]
    return [*rows, ("", "en"), (None, "fr"), (" \t\n.", "fr"), ("w " * 30000, "en"), ("one two three four. " * 12, "es"), *[("one two three four. " * 12, "es")] * 2]


def documents(spark, rows):
    return spark.createDataFrame([(i % 7, t, lang, "x", 1) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize("longest, top", [(3, 2000), (2, 5), (4, 40)])
def test_phrases_equal_a_plain_count(spark, longest, top):
    got = ph.collocations(documents(spark, texts()), longest, top=top, power=16, shard=5000)
    assert sorted(map(tuple, got.collect())) == plain(texts(), longest, top=top)


def test_empty_table(spark):
    assert ph.collocations(documents(spark, texts(1)).limit(0), power=16).count() == 0


def test_slots_are_minimal_and_perfect():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        keys = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        slots = ph.Slots(keys)
        assert sorted(slots.of(keys)) == list(range(len(keys))) == list(range(slots.size))


def test_stored_keys_settle_equal_hashes():
    phrase = pa.array([f"w{i % 40}" for i in range(100)])
    lang = pa.array(["en" if i % 80 < 40 else "de" for i in range(100)])
    h = np.array([i % 40 % 7 for i in range(100)], np.uint64)
    keys = ph.Keys(lang, phrase, h)
    at = keys.of(lang, phrase, h)
    assert keys.size == 80 == len(set(at)) and all(at[i] == at[i - 80] for i in range(80, 100))
    assert keys.of(pa.array(["fr", "en"]), pa.array(["w1", "w1"]), np.array([1, 3], np.uint64)).tolist() == [-1, -1]
    stored = keys.stored()
    assert all((stored[0][int(s)].as_py(), stored[1][int(s)].as_py()) == (lang[i].as_py(), phrase[i].as_py()) for i, s in enumerate(at))


def test_hashes_and_filter_follow_spark(spark):
    phrases = [f"é w{i} x{i % 7}"[: 2 + 9 * (i % 3)].strip() for i in range(500)]
    bits = ph.filter_of(spark.createDataFrame([("en", p) for p in phrases], "lang string, phrase string"), 14)

    def of(phrase, lang=b"en"):
        words = [w.encode() for w in phrase.split(" ")]
        return np.bitwise_xor.reduce([ph.turned(ph.hashes(lang, pa.array([w], pa.binary())), k)[0] for k, w in enumerate(words)])

    assert ph.may_hold(bits, np.array([of(p) for p in phrases])).all()
    assert ph.may_hold(bits, np.array([of(f"q{i} r", b"de") for i in range(500)])).mean() < 0.1
    for level in (1, 2):
        seen, _ = ph.phrases_of([b"a b c. b a c, a b"], b"en", [np.full(2048, 255, np.uint8)] * level)
        assert sorted(seen.to_pylist()) == ([b"a b", b"a c", b"b a", b"b c"] if level == 1 else [b"a b c", b"b a c"])


def test_requests_for_one_key_are_dealt_over_copies(spark):
    known = spark.createDataFrame([("en", f"w{i}", i) for i in range(50)], "lang string, phrase string, f long")
    asked = spark.range(3000).selectExpr("'en' lang", "if(id % 3 > 0, 'w7', concat('w', id % 60)) part", "id")
    got = ph.looked_up(asked, known, ["id"], cell=9, most=200)
    want = {i: 7 if i % 3 else (i % 60 if i % 60 < 50 else None) for i in range(3000)}
    assert {r.id: r.f for r in got.collect()} == want


def test_query_equals_sql(spark, tmp_path):
    documents(spark, [r for r in texts(120) if len(r[0] or "") < 10_000]).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, ph.op13_phrases(spark, str(tmp_path)).collect())) == sorted(con.sql(ph.SQL).fetchall())
