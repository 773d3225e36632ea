"""Paths of contigs of few segments, which a row holds, and of many, which grow by joins."""

import itertools

import pytest
from pyspark.sql import functions as F

from junctura.operators import segments as S


def _contigs():
    rows = []
    for query, steps in (("few", 3), ("many", 30)):
        for k in range(steps):
            rows.append((f"{query}{k}", query, steps * 100, f"chr{k % 3}", k * 100 + 1, (k + 1) * 100))
        rows.append((f"{query}_other", query, steps * 100, "chr9", 101, 200))
    rows += [("lone", None, 100, "chr1", 1, 100), ("gap0", "gap", 300, "chr1", 1, 100), ("gap1", "gap", 300, "chr1", 201, 300)]
    return rows


COLUMNS = "seg_id string, query string, query_len int, target string, qstart bigint, qend bigint"


def _paths(spark, rows, **more):
    found = S.paths(spark.createDataFrame(rows, COLUMNS), **more)
    assert found.columns == ["query", "path", "targets", "overlapped", "covered", "share", "n"]
    return sorted((r["query"] or "", tuple(r["path"]), tuple(r["targets"]), r["overlapped"], r["covered"], r["n"]) for r in found.collect())


@pytest.mark.parametrize("in_row", [0, 3, 24])
def test_both_ways_give_the_same_paths(spark, in_row):
    rows = _contigs()
    found = _paths(spark, rows, in_row=in_row)
    assert found == _paths(spark, rows, in_row=100)
    assert [(q, n) for q, *_, n in found] == [("", 1), ("few", 1), ("few", 2), ("many", 1), ("many", 2)]
    many = tuple(f"many{k}" for k in range(30))
    assert {p for q, p, *_ in found if q == "many"} == {many, (many[0], "many_other", *many[2:])}


def test_contigs_of_few_segments_need_no_rounds(spark, monkeypatch):
    """Every step that was written and read again for each segment of a contig: now one table, of the contigs of many segments."""
    written = []
    monkeypatch.setattr(S, "cut", lambda df: written.append(df) or df.localCheckpoint())
    rows = [r for r in _contigs() if r[1] == "few"]
    assert len(_paths(spark, rows)) == 2
    assert len(written) == 1


def test_alternatives_at_each_step(spark):
    rows = [(f"{k}{a}", "q", 1200, f"chr{a}", k * 100 + 1, (k + 1) * 100) for k, a in itertools.product(range(12), (1, 2))]
    found = S.paths(spark.createDataFrame(rows, COLUMNS))
    assert found.agg(F.count("*"), F.countDistinct("path"), F.max("n")).first() == (4096, 4096, 4096)
