"""Fusions that no contig shows, from reads whose mates lie on transcripts of other genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.transcripts import to_genome
from ..operators.rescue import clip_break, discordant_pairs, genome_orient, nearest_bound


def breaks(reads: DataFrame, transcripts: DataFrame, most: int = 10) -> DataFrame:
    """(name, gene, chrom, break, orient): where clipped reads (name, target, pos, tend, cigar) break off their transcript, in the
    genome, moved to an exon bound at most ``most`` bases away if there is one."""
    t = transcripts.select(F.col("tid").alias("target"), "gene", "chrom", F.col("strand").alias("_strand"), "exons")
    rows = reads.withColumn("_clip", clip_break(F.col("cigar"), F.col("pos"), F.col("tend"))).where("_clip is not null").join(t, "target")
    rows = rows.withColumns({"_pos": to_genome(F.col("exons"), F.col("_strand"), F.col("_clip.pos")), "orient": genome_orient(F.col("_strand"), F.col("_clip.orient"))})
    at = F.coalesce(nearest_bound(F.col("exons"), F.col("_pos"), F.col("orient"), most), F.col("_pos"))
    return rows.where("_pos is not null").select("name", "gene", "chrom", at.alias("break"), "orient")


def fusions(reads: DataFrame, transcripts: DataFrame, least: int = 4) -> DataFrame:
    """(gene1, gene2, pairs, chrom1, break1, orient1, chrom2, break2, orient2) of pairs of genes with at least ``least`` discordant pairs of reads.

    A gene's break is the one that most clipped reads of these pairs show, ties to the lower place; null where none is clipped.
    ``reads``: name, mate, target, pos, tend, cigar.
    """
    genes = transcripts.select(F.col("tid").alias("target"), "gene")
    found = discordant_pairs(reads, genes, least)
    named = reads.join(genes, "target").select("name", "mate", "gene").distinct()
    two = named.alias("a").join(named.alias("b"), (F.col("a.name") == F.col("b.name")) & (F.col("a.mate") == 1) & (F.col("b.mate") == 2) & (F.col("a.gene") != F.col("b.gene")))
    of_pair = two.select(F.col("a.name").alias("name"), F.least("a.gene", "b.gene").alias("gene1"), F.greatest("a.gene", "b.gene").alias("gene2")).distinct()
    votes = of_pair.join(found.select("gene1", "gene2"), ["gene1", "gene2"], "left_semi").join(breaks(reads, transcripts), "name").where("gene in (gene1, gene2)")
    votes = votes.groupBy("gene1", "gene2", "gene", "chrom", "break", "orient").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("gene1", "gene2", "gene").orderBy(F.desc("n"), "chrom", "break", "orient"))
    best = votes.withColumn("_nth", nth).where("_nth = 1")
    for k in (1, 2):
        side = best.where(F.col("gene") == F.col(f"gene{k}")).select("gene1", "gene2", F.col("chrom").alias(f"chrom{k}"), F.col("break").alias(f"break{k}"), F.col("orient").alias(f"orient{k}"))
        found = found.join(side, ["gene1", "gene2"], "left")
    return found
