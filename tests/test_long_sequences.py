"""Pieces and copies in long sequences, against plain Python."""

import random
import re

import pytest
from junctura.functions import sequences as Q
from pyspark.sql import functions as F


def _texts():
    draw = random.Random(3)
    texts = ["", "A", "ACGTAC", "ACGTACG" * 3, "AC" * 300 + "G" + "CA" * 300, "A" * 900, "".join(draw.choices("ACGT", k=2500))]
    return texts + ["".join(draw.choices("AC", k=draw.randint(30, 700), weights=(9, 1))) for _ in range(20)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate(_texts())), "name int, seq string")


@pytest.mark.parametrize("most", [1, 7, 200])
def test_pieces(table, most):
    got = sorted(map(tuple, Q.pieces(table, 3, F.length("seq") - 5, 4, 6, ["name"], most=most).collect()))
    assert got == sorted((n, k, s[k - 1 : k + 5]) for n, s in enumerate(_texts()) for k in range(3, len(s) - 4, 4))


@pytest.mark.parametrize("most", [3, 200])
def test_copies(table, most):
    """Runs that fill the letters looked at are counted in the whole sequence."""
    want = []
    for n, s in enumerate(_texts()):
        for k in range(11, len(s) - 1, 10):
            unit = s[k - 1 : k + 1]
            up, down = re.search(f"((?:{unit})*)$", s[: k - 1]).group(1), re.match(f"(?:{unit})*", s[k + 1 :]).group(0)
            want.append((n, k, len(up) // 2, len(down) // 2))
    got = sorted(map(tuple, Q.copies_around(table, 11, F.length("seq") - 2, 10, 2, ["name"], most=most).collect()))
    assert got == sorted(want) and max(w[2] for w in want) > 200


def test_whole_sequences_are_not_copied_to_pieces(table):
    """Before, each piece was looked up in a copy of the whole sequence; now the step that gives pieces holds none."""
    plan = Q.pieces(table, 1, F.length("seq") - 5, 3, 6, ["name"])._jdf.queryExecution().optimizedPlan().toString()
    last = next(line for line in plan.splitlines() if "Generate" in line)
    assert "seq#" not in last


def test_copies_of_any_case_and_size_in_time_of_the_length(spark):
    """Before, each place searched its own pieces, some 50 microseconds each: a million places took most of a minute on a core."""
    import time

    draw = random.Random(9)
    texts = ["acACgtgtGTé" * 20, "é" * 60 + "aAaA" * 9, "".join(draw.choices("acAC", k=400))]
    table = spark.createDataFrame(list(enumerate(texts)), "name int, seq string")
    want = []
    for n, s in enumerate(texts):
        for k in range(2, len(s) - 1, 3):
            unit, s_ = re.escape(s[k - 1 : k + 2]), s
            up, down = re.search(f"(?i)((?:{unit})*)$", s_[: k - 1]).group(1), re.match(f"(?i)(?:{unit})*", s_[k + 2 :]).group(0)
            want.append((n, k, len(up) // 3, len(down) // 3))
    assert sorted(map(tuple, Q.copies_around(table, 2, F.length("seq") - 2, 3, 3, ["name"]).collect())) == sorted(want)
    long = spark.createDataFrame([(1, "ACCA" * 2_500_000)], "name int, seq string")
    began = time.time()
    assert Q.copies_around(long, 1, F.length("seq") - 1, 10, 2, ["name"]).count() == 1_000_000 and time.time() - began < 15
