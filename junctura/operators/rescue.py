"""Fusions from discordant pairs of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import exact_matches, is_homopolymer_fragment
from ..functions.transcripts import to_genome


def mates_without_target(reads: DataFrame) -> DataFrame:
    """Unmapped reads (name, mate, seq) whose mate is mapped, with the mate's target."""
    mapped = reads.where(F.col("flag").bitwiseAND(4) == 0).select("name", F.col("mate").alias("_mate"), F.col("target").alias("mate_target"))
    alone = reads.where(F.col("flag").bitwiseAND(4) != 0)
    return alone.join(mapped, "name").where("mate <> _mate").select("name", "mate", "seq", "mate_target")


def discordant_pairs(reads: DataFrame, genes: DataFrame, least: int = 4) -> DataFrame:
    """(gene1, gene2, pairs) with gene1 before gene2: pairs of mates on transcripts of different genes, counted once for each name, of which
    there are at least ``least``. ``reads``: name, mate (1 or 2), target; ``genes``: target, gene."""
    named = reads.join(genes, "target").select("name", "mate", "gene").distinct()
    one, two = named.where("mate = 1").select("name", F.col("gene").alias("_a")), named.where("mate = 2").select("name", F.col("gene").alias("_b"))
    pairs = one.join(two, "name").where("_a <> _b").select("name", F.least("_a", "_b").alias("gene1"), F.greatest("_a", "_b").alias("gene2")).distinct()
    return pairs.groupBy("gene1", "gene2").agg(F.count("*").alias("pairs")).where(F.col("pairs") >= least)


def clip_break(cigar: Column, pos: Column, tend: Column) -> Column:
    """Where a read is clipped on its target: (pos, orient), the longer clip if both ends are; null without one."""
    first, last = F.get(cigar, F.lit(0)), F.element_at(cigar, -1)
    left = F.when(first["op"].isin("S", "H"), first["len"]).otherwise(0)
    right = F.when(last["op"].isin("S", "H") & (F.size(cigar) > 1), last["len"]).otherwise(0)
    return F.when((left == 0) & (right == 0), None).when(left > right, F.struct(pos.cast("bigint").alias("pos"), F.lit("R").alias("orient"))).otherwise(F.struct(tend.cast("bigint").alias("pos"), F.lit("L").alias("orient")))


def genome_orient(strand: Column, orient: Column) -> Column:
    """The orientation on the genome of one on a transcript."""
    return F.when(strand == "+", orient).otherwise(F.translate(orient, "LR", "RL"))


def nearest_bound(exons: Column, pos: Column, orient: Column, most: int = 10) -> Column:
    """The exon bound (its end for L, its start for R) nearest to a genome position, at most ``most`` away; null if none is."""
    ends = F.transform(exons, lambda e: F.when(orient == "L", e["end"]).otherwise(e["start"]))
    best = F.array_min(F.transform(ends, lambda e: F.struct(F.abs(e - pos).alias("far"), e.alias("bound"))))
    return F.when(best["far"] <= most, best["bound"])


def frame_of(length5: Column, length3: Column) -> Column:
    """Whether the coding bases kept upstream and dropped downstream leave the frame as it is."""
    return (length5 - length3) % 3 == 0


def unaligned_ends(alignments: DataFrame, contigs: DataFrame, external: DataFrame | None = None, least: int = 16) -> DataFrame:
    """(seg_id, query, side, qstart, qend, seq): the ends of contigs that their only alignment leaves out, of ``least`` bases or more and not
    mostly of one base. Contigs that ``external`` (query, state) maps in full are left out.

    ``alignments``: seg_id, query, qstart, qend, one or more for each contig; ``contigs``: name, seq.
    """
    alone = alignments.groupBy("query").agg(F.count("*").alias("_n"), F.first("seg_id").alias("seg_id"), F.min("qstart").alias("_s"), F.max("qend").alias("_e")).where("_n = 1")
    if external is not None:
        alone = alone.join(external.where("state = 'full'").select("query").distinct(), "query", "left_anti")
    rows = alone.join(contigs.select(F.col("name").alias("query"), F.col("seq").alias("_seq")), "query")
    n = F.length("_seq")
    part = lambda side, a, b: F.struct(F.lit(side).alias("side"), a.cast("bigint").alias("qstart"), b.cast("bigint").alias("qend"))
    ends = F.explode(F.array(part("start", F.lit(1), F.col("_s") - 1), part("end", F.col("_e") + 1, n)))
    rows = rows.select("seg_id", "query", "_seq", ends.alias("p")).select("seg_id", "query", "p.*", F.when(F.col("p.qend") >= F.col("p.qstart"), F.substr("_seq", F.col("p.qstart").cast("int"), (F.col("p.qend") - F.col("p.qstart") + 1).cast("int"))).alias("seq"))
    return rows.where((F.length("seq") >= least) & ~is_homopolymer_fragment(F.upper("seq")))


def rescued(ends: DataFrame, transcripts: DataFrame, on_genome: bool = True) -> DataFrame:
    """New alignments (seg_id, query, side, target, strand, qstart, qend, tstart, tend) of unaligned ends that lie in their transcript, word for word, in
    exactly one place; with the alignment they come from they make a pair of segments.

    ``ends``: rows of ``unaligned_ends`` with tid; ``transcripts``: tid, chrom, strand, exons, seq (in transcript direction).
    """
    rows = ends.join(transcripts.select("tid", "chrom", F.col("strand").alias("_strand"), "exons", F.upper("seq").alias("_tseq")), "tid")
    hits = exact_matches(F.col("_tseq"), F.upper("seq"))
    rows = rows.withColumn("_hits", hits).where((F.size("_hits") == 1) & (F.length("_tseq") >= F.length("seq")))
    a = F.get("_hits", F.lit(0))["start"]
    b, own = a + F.length("seq") - 1, F.get("_hits", F.lit(0))["strand"]
    if not on_genome:
        return rows.select("seg_id", "query", "side", F.col("tid").alias("target"), own.alias("strand"), "qstart", "qend", a.cast("bigint").alias("tstart"), b.cast("bigint").alias("tend"))
    x, y = to_genome(F.col("exons"), F.col("_strand"), a), to_genome(F.col("exons"), F.col("_strand"), b)
    strand = F.when(F.col("_strand") == own, "+").otherwise("-")
    return rows.select("seg_id", "query", "side", F.col("chrom").alias("target"), strand.alias("strand"), "qstart", "qend", F.least(x, y).alias("tstart"), F.greatest(x, y).alias("tend"))
