"""CIGARs are worked out once, however many results name them."""

import contextlib
import io

from pyspark.sql import functions as F

from junctura.catalog import QUERIES
from junctura.functions import cigar as C

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_blocks_are_folded_once(spark):
    row = spark.createDataFrame([("5S40M7D30M", 1, "-")], "text string, pos int, strand string").withColumn("cigar", C.parse_cigar(F.col("text")))
    made = C.blocks(F.col("cigar"), F.col("pos"), F.col("strand"))
    n = plan(row.select(made.alias("x"))).count("aggregate(")
    assert plan(row.select(C.gaps(made).alias("x"))).count("aggregate(") == n
    assert plan(row.select(C.lift(made, F.col("strand"), F.lit(20)).alias("x"))).count("aggregate(") == n
    out = row.select(C.gaps(made).alias("g"), C.lift(made, F.col("strand"), F.lit(20)).alias("l"), C.lift(made, F.col("strand"), F.lit(200)).alias("none")).first()
    assert [(g.i, g.tgap, g.qgap) for g in out.g] == [(0, 7, 0)] and out.l == 58 and out.none is None


def test_lift_parses_no_cigar_twice(spark):
    assert plan(QUERIES["query_position_lift"](spark, SF)).count("regexp_extract_all") == 1
