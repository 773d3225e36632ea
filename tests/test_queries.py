"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from junctura.catalog import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()
CHOSEN = sorted(k for k in SQL if not k.startswith(("vcf_", "pair_", "somatic", "filter_adjacency", "event_sizes", "bad_region", "variant_min", "support_join", "bedpe")))


def rows(frame):
    names = sorted(frame.columns)
    cell = lambda v: "" if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return names, sorted(tuple(cell(v) for v in r) for r in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(SQL[name]).df())
