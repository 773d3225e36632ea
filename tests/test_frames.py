"""Reading frames of whole sequences against brute force."""

import random

from junctura.catalog import QUERIES

BASES = "TCAG"
CODE = {a + b + c: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}


def letters(text):
    return "".join("ACGT"[(ord(c) - 97) % 4] if c != "z" else "C" for c in text.lower() if "a" <= c <= "z")


def plain_frames(seq):
    for strand, s in (("+", seq), ("-", seq[::-1].translate(str.maketrans("ACGT", "TGCA")))):
        for f in range(3):
            yield strand, f, "".join(CODE[s[i : i + 3]] for i in range(f, len(s) - 2, 3))


def plain_open(seq):
    found = sorted((-len(p), strand, f, p) for strand, f, aa in plain_frames(seq) for p in aa.split("*") if len(p) >= 10)
    return len(found), found[0][3] if found else None


def plain_in_frame(seq):
    """Whether a stretch of a frame crosses the middle with five residues of the proteins of both halves beside it."""
    mid = len(seq) // 2
    halves = (seq[: mid + 30], seq[max(mid - 31, 0) :])
    if not all(halves):
        return None
    up, down = ([p for _, _, aa in plain_frames(h) for p in aa.split("*") if len(p) > 1] for h in halves)
    for strand, f, aa in plain_frames(seq):
        a, b = (mid, mid + 1) if strand == "+" else (len(seq) - mid, len(seq) - mid + 1)
        left, right, at = (a - f) // 3, (b - f + 1) // 3, 0
        for p in aa.split("*"):
            if at <= left - 5 and right + 5 <= at + len(p):
                x, y = aa[left - 5 : left], aa[right : right + 5]
                for u, d in ((up, down), (down, up)):
                    if any(x in q for q in u) and any(y in q for q in d):
                        return True
            at += len(p) + 1
    return False


def test_frames_of_whole_sequences(spark, tmp_path):
    r = random.Random(7)
    texts = ["".join(r.choice("abcdefghij kxyz") for _ in range(n)) for n in (0, 1, 2, 3, 31, 59, 90, 119, 120, 121, 299, 400, 900, 3000, 3600, 9000) for _ in range(3)]
    hidden = "tag" * 200 + "gct" * 400 + "tag" * 900
    rows = list(enumerate([*texts, hidden, "a" * 5000, "A b-C é ÿ z" * 40, None]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seqs = {str(i): None if t is None else letters(t) for i, t in rows}
    want = {k: (None, None) if s is None else plain_open(s) for k, s in seqs.items()}
    assert {x.name: (x.n, x.longest) for x in QUERIES["open_reading_frames"](spark, str(tmp_path)).collect()} == want
    assert {x.name: x.in_frame for x in QUERIES["frame_by_orf"](spark, str(tmp_path)).collect()} == {k: None if s is None else plain_in_frame(s) for k, s in seqs.items()}
