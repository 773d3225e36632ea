"""Filtering of reported adjacencies and variants by the support of other reads, and what a tumour has that its normal lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def support_of(adjacencies: DataFrame, support: DataFrame) -> DataFrame:
    """Adjacencies (adj_id, contig, cb1, cb2, the last three lists joined by commas) with spanning and flanking reads summed over their contigs; null
    where no contig has any.

    ``support``: contig, span1, span2, spanning, flanking.
    """
    parts = F.explode(F.arrays_zip(F.split("contig", ",").alias("c"), F.split("cb1", ",").alias("a"), F.split("cb2", ",").alias("b"))).alias("p")
    spans = adjacencies.select("adj_id", parts).select("adj_id", F.col("p.c").alias("contig"), F.col("p.a").cast("bigint").alias("a"), F.col("p.b").cast("bigint").alias("b"))
    spans = spans.select("adj_id", "contig", F.least("a", "b").alias("span1"), F.greatest("a", "b").alias("span2"))
    known = support.select("contig", F.least("span1", "span2").alias("span1"), F.greatest("span1", "span2").alias("span2"), "spanning", "flanking")
    total = spans.join(known, ["contig", "span1", "span2"]).groupBy("adj_id").agg(F.sum("spanning").alias("spanning"), F.sum("flanking").alias("flanking"))
    return adjacencies.drop("spanning", "flanking").join(total, "adj_id", "left")


def passed(adjacencies: DataFrame, least: int = 2) -> DataFrame:
    """Adjacencies that at least ``least`` reads span; flanking pairs do not count."""
    return adjacencies.where(F.coalesce("spanning", F.lit(0)) >= least)


def variants_passed(variants: DataFrame, adjacencies: DataFrame, least: int = 2) -> DataFrame:
    """Variants (variant_id, adj_ids) without those that have a failing adjacency, with the smallest support of a variant's adjacencies.

    Variants that name an adjacency which is not in the table stay, without support.
    """
    parts = variants.select("variant_id", F.explode("adj_ids").alias("adj_id")).join(adjacencies.select("adj_id", "spanning", "flanking", F.lit(True).alias("_there")), "adj_id", "left")
    each = parts.groupBy("variant_id").agg(
        F.min(F.coalesce("spanning", F.lit(0))).alias("spanning"), F.min("flanking").alias("flanking"), F.bool_and(F.coalesce("_there", F.lit(False))).alias("_whole")
    )
    rows = variants.drop("spanning", "flanking").join(each, "variant_id").where(~F.col("_whole") | (F.col("spanning") >= least))
    return rows.withColumns({c: F.when(F.col("_whole"), F.col(c)) for c in ("spanning", "flanking")}).drop("_whole")


def tumour_only(adjacencies: DataFrame, tumour: DataFrame, normal: DataFrame, least: int = 2, least_normal: int = 2) -> tuple[DataFrame, DataFrame]:
    """(somatic, germline): adjacencies that the tumour's reads support, without and with support of the normal's."""
    in_tumour = passed(support_of(adjacencies, tumour), least)
    in_normal = passed(support_of(adjacencies, normal), least_normal).select("adj_id")
    return in_tumour.join(in_normal, "adj_id", "left_anti").withColumn("somatic", F.lit(True)), in_tumour.join(in_normal, "adj_id", "left_semi").withColumn("somatic", F.lit(False))
