"""BEDPE, BED, FASTA and tab-separated renderings; unset values become the format's own mark only here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENOME_BEDPE = (
    "chrom1 start1 end1 chrom2 start2 end2 name score strand1 strand2 orient1 orient2 event size contig contig-break1 contig-break2 homol_seq homol_coord1 homol_coord2 novel_seq repeat_seq repeat_num "
    "repeat_change probe spanning_reads flanking_pairs"
).split()
TRANSCRIPT_BEDPE = (
    "chrom1 start1 end1 chrom2 start2 end2 name score strand1 strand2 orient1 orient2 event size gene1 transcript1 transcript_break1 exon1 exon_bound1 gene2 transcript2 transcript_break2 exon2 exon_bound2 "
    "gene_5prime gene_3prime exon_5prime exon_3prime feature seq_id seq_breaks ins_seq homol_seq homol_seq_coords novel_seq novel_seq_coords copy_number_change repeat_seq in_frame splice_motif probe "
    "support_span spanning_reads flanking_pairs"
).split()
SPLICE_BEDPE = (
    "chrom1 start1 end1 chrom2 start2 end2 name score strand1 strand2 event gene transcript size exon1 exon2 seq_id seq_breaks in_frame splice_motif probe support_reads splice_site_variant genome_support"
).split()


def _line(cells: list[Column]) -> Column:
    return F.concat_ws("\t", *cells)


def genome_bedpe(events: DataFrame) -> DataFrame:
    """(value), one line of 27 columns for each adjacency; columns that events lack, and nulls, are -. Sizes of translocations are NA."""
    has = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("-")) if n in events.columns else F.lit("-")
    size = F.coalesce(F.col("size").cast("string"), F.lit("NA"))
    b = lambda n: [F.col(f"chrom{n}"), (F.col(f"break{n}") - 1).cast("string"), F.col(f"break{n}").cast("string")]
    cells = [*b(1), *b(2), F.col("adj_id").cast("string"), F.lit("."), F.lit("+"), F.lit("+"), has("orient1"), has("orient2"), F.col("rearrangement"), size]
    cells += [has(n) for n in ("contig", "cb1", "cb2", "homol_seq", "homol1", "homol2", "novel_seq", "repeat_seq", "repeat_num", "repeat_change", "probe", "spanning", "flanking")]
    return events.select(_line(cells).alias("value"))


def table_lines(rows: DataFrame, columns: list[str], unset: str = "na") -> DataFrame:
    """(value), one line for each row with these columns; columns that rows lack, and nulls, are ``unset``."""
    return rows.select(_line([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(unset)) if c in rows.columns else F.lit(unset) for c in columns]).alias("value"))


def transcript_bedpe(events: DataFrame) -> DataFrame:
    """One line of 44 columns for each event, from columns of those names and break1, break2, report_id."""
    rows = events.withColumns({"start1": F.col("break1") - 1, "end1": F.col("break1"), "start2": F.col("break2") - 1, "end2": F.col("break2"), "name": F.col("report_id"), "score": F.lit(".")})
    return table_lines(rows, TRANSCRIPT_BEDPE)


def splice_bedpe(events: DataFrame) -> DataFrame:
    """One line of 24 columns for each event; the second anchor is the break and the base after it."""
    rows = events.withColumns({"start1": F.col("break1") - 1, "end1": F.col("break1"), "start2": F.col("break2"), "end2": F.col("break2") + 1, "score": F.lit(".")})
    return table_lines(rows, SPLICE_BEDPE)


def break_bed(events: DataFrame) -> DataFrame:
    """One BED line for each of an adjacency's breaks, named by the adjacency's columns."""
    name = F.concat_ws("-", "rearrangement", "chrom1", "break1", "orient1", "chrom2", "break2", "orient2")
    each = F.explode(F.array(*[F.struct(F.col(f"chrom{n}").alias("c"), F.col(f"break{n}").alias("b")) for n in (1, 2)]))
    return events.select(name.alias("name"), each.alias("x")).select(_line([F.col("x.c"), (F.col("x.b") - 1).cast("string"), F.col("x.b").cast("string"), F.col("name")]).alias("value"))


def bed12(rows: DataFrame, name: Column, score: Column, blocks: Column, chrom: Column, strand: Column) -> DataFrame:
    """BED12 lines from blocks (ts, te) in ascending order."""
    first, last = F.get(blocks, F.lit(0))["ts"], F.element_at(blocks, -1)["te"]
    each = lambda f: F.array_join(F.transform(blocks, f), ",")
    cells = [chrom, first - 1, last, name, score, strand, first - 1, last, F.lit("0"), F.size(blocks), each(lambda x: (x["te"] - x["ts"] + 1).cast("string")), each(lambda x: (x["ts"] - first).cast("string"))]
    return rows.select(_line([c.cast("string") for c in cells]).alias("value"))


def junction_bed(junctions: DataFrame) -> DataFrame:
    """BED12 lines of junctions (target, pos1, pos2, gene, tid, exon1, exon2, depth): one base on either side, the depth as score."""
    blocks = F.array(F.struct(F.col("pos1").alias("ts"), F.col("pos1").alias("te")), F.struct(F.col("pos2").alias("ts"), F.col("pos2").alias("te")))
    name = F.concat(F.col("gene"), F.lit("."), F.col("tid"), F.lit(".E"), F.col("exon1"), F.lit(".E"), F.col("exon2"))
    return bed12(junctions, name, F.col("depth"), blocks, F.col("target"), F.lit("+"))


def single_alignments_bed(segments: DataFrame, least: int = 0) -> DataFrame:
    """BED12 lines, in order of place, of contigs that have one alignment."""
    from pyspark.sql import Window

    rows = segments.withColumn("_n", F.count("*").over(Window.partitionBy("query"))).where(F.col("_n") == 1).where(F.col("query_len") >= least)
    rows = rows.repartitionByRange("target", "tstart").sortWithinPartitions("target", "tstart", "tend")
    return bed12(rows, F.col("query"), F.lit(0), F.col("blocks"), F.col("target"), F.col("strand"))


def mapping_lines(mapped: DataFrame) -> DataFrame:
    """contig, gene, transcript and coverage, genes together, the best covered first."""
    rows = mapped.repartitionByRange("gene").sortWithinPartitions("gene", F.desc("coverage"))
    return rows.select(_line([F.col("query"), F.col("gene"), F.col("tid"), F.format_string("%.3f", "coverage")]).alias("value"))


def fasta_lines(rows: DataFrame, name: Column, seq: Column) -> DataFrame:
    """Two lines in one value for each row whose sequence is there."""
    return rows.where(seq.isNotNull()).select(F.concat(F.lit(">"), name, F.lit("\n"), seq).alias("value"))


def support_lines(support: DataFrame) -> DataFrame:
    return support.select(_line([F.col("contig"), F.concat_ws("-", "span1", "span2"), F.col("spanning").cast("string"), F.col("flanking").cast("string")]).alias("value"))


def coordinate_lines(variants: DataFrame, adjacencies: DataFrame) -> DataFrame:
    """contig, span and kind of each adjacency of variants: gapped where a variant has one adjacency of del, ins, dup or indel that says so, else split."""
    rows = variants.select(F.explode("adj_ids").alias("adj_id"), F.size("adj_ids").alias("_n")).join(adjacencies, "adj_id")
    kind = F.when((F.col("_n") == 1) & (F.col("align_type") == "gapped"), "gapped").otherwise("split")
    return rows.select(_line([F.col("contig"), F.col("cb1").cast("string"), F.col("cb2").cast("string"), kind]).alias("value"))


def write_lines(lines: DataFrame, path: str, head: list[str] | None = None) -> None:
    """Writes lines as text, a header in a part of its own before them."""
    first = lines.sparkSession.range(1, numPartitions=1).select(F.explode(F.array(*[F.lit(h) for h in head or [""]])).alias("value"))
    (first.union(lines) if head else lines).write.text(path)
