"""Secrets of which a base pattern covers only a part; overlaps and redaction against plain versions; time in long texts."""

import random
import time

import pytest

from junctura.llm import pii


@pytest.mark.parametrize("secret", ["api_key: 4111111111111111-abcdef0123456789", "token=10.1.2.3abcdefghijk", "token: 4111111111111111abcdef0123456789"])
def test_rest_of_a_secret_does_not_stay(spark, secret):
    docs = spark.createDataFrame([(1, f"set {secret} in the file")], "doc_id long, text string")
    found = pii.spans(docs).first()
    text = pii.redact(docs).first().text
    assert text.startswith("set ") and text.endswith(" in the file") and "abcdef" not in text


def plain_redaction(text, found):
    out, at = [], 0
    for s, k, e in sorted(found):
        if s >= at:
            out += [text[at:s], f"[{pii.KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_redaction_equals_a_plain_one_in_texts_of_many_spans(spark):
    r = random.Random(6)
    makers = [lambda: "a.b@c.org", lambda: "10.1.2.3", lambda: "+1 (956) 555-0122", lambda: "415-555-1212", lambda: "token=" + "".join(r.choice("0123456789abcdef") for _ in range(24)), lambda: "api_key: 4111111111111111-abcdef0123456789", lambda: "wörd é😀 the", lambda: "\n"]
    texts = ["call me at " + " phone ".join(r.choice(makers)() for _ in range(n)) for n in (0, 1, 3, 40, 255, 256, 257, 700, 1500)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, base string, cut int")
    found = {x.doc_id: x for x in pii.spans(docs).collect()}
    new = {x.doc_id: x.text for x in pii.redact(docs).collect()}
    for i, t in enumerate(texts):
        base, added = [tuple(x) for x in found[i].base], [tuple(x) for x in found[i].added]
        assert not any(b[1] < a[1] and b[0] <= a[0] and a[2] <= b[2] for a in added for b in base + added)
        assert new[i] == (None if t is None else plain_redaction(t, base + added))
    assert pii.redact(docs.limit(0)).count() == pii.spans(docs.limit(0)).count() == 0


def test_time_is_about_linear_in_the_spans_of_a_text(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, "call 415-555-1212 a@b.org " * n)], "doc_id long, text string")
        began = time.perf_counter()
        assert pii.redact(docs).first().text == "call [NUMBER] [EMAIL] " * n
        return time.perf_counter() - began

    seconds(10)
    few = seconds(4000)
    assert seconds(16_000) < 8 * few + 2
