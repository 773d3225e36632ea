"""Fusions, duplications and indels of transcripts from alignments of assembled contigs to transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import transcripts as X
from ..functions.sequences import balanced_probe
from ..operators import exons as E
from ..operators import fusion as U
from ..operators import segments as S
from ..operators import support as R
from ..operators.rescue import genome_orient, rescued, unaligned_ends

SIDE = ("tid", "gene", "chrom", "strand", "coding", "cds_start", "cds_end", "exons")


def located(pairs: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Classified pairs of transcript segments with each side's transcript, genome break and orientation, exon, exon bound and UTR.
    Breaks on the transcripts stay as tx_break1 and tx_break2."""
    rows = pairs.withColumnsRenamed({"chrom1": "tid1", "chrom2": "tid2", "break1": "tx_break1", "break2": "tx_break2", "strand1": "align_strand1", "strand2": "align_strand2"})
    for n in (1, 2):
        side = transcripts.select(*[F.col(c).alias(f"{c}{n}") for c in SIDE])
        rows = rows.join(side, f"tid{n}")
    for n in (1, 2):
        exons, strand = F.col(f"exons{n}"), F.col(f"strand{n}")
        rows = rows.withColumns({f"break{n}": X.to_genome(exons, strand, F.col(f"tx_break{n}")), f"orient{n}": genome_orient(strand, F.col(f"orient{n}"))})
    return _placed(rows)


def located_on_genome(pairs: DataFrame, segments: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The same for classified pairs of genome segments: each side gets the best transcript at its break. ``segments``: seg_id, target, tstart, tend,
    blocks. Pairs with a side that maps to no transcript are left out. tx_break1 and tx_break2 are null for breaks outside exons."""
    mapped = E.map_alignments(segments.select("seg_id", "target", "tstart", "tend", "blocks"), transcripts)
    rows = pairs.withColumnsRenamed({"strand1": "align_strand1", "strand2": "align_strand2"})
    for n in (1, 2):
        breaks = F.array("break1", "break2") if n == 1 else F.array("break2")
        asked = pairs.select(F.col("seg1").alias("_event"), F.col(f"seg{n}").alias("seg_id"), F.col(f"orient{n}").alias("orient"), breaks.alias("breaks"))
        best = E.best_at_break(mapped.join(asked, "seg_id"), "_event").withColumnRenamed("tx_strand", "strand").withColumnRenamed("target", "chrom")
        side = best.select("_event", *[F.col(c).alias(f"{c}{n}") for c in SIDE if c != "chrom"])
        rows = rows.join(side, F.col("seg1") == F.col("_event")).drop("_event")
    for n in (1, 2):
        rows = rows.withColumn(f"tx_break{n}", X.to_transcript(F.col(f"exons{n}"), F.col(f"strand{n}"), F.col(f"break{n}")))
    return _placed(rows)


def _placed(rows: DataFrame) -> DataFrame:
    for n in (1, 2):
        exons, strand, at = F.col(f"exons{n}"), F.col(f"strand{n}"), F.col(f"break{n}")
        rows = rows.withColumns(
            {
                f"exon{n}": X.exon_at(exons, strand, at),
                f"bound{n}": X.at_exon_bound(exons, at, F.when(F.col(f"orient{n}") == "L", "end").otherwise("start")),
                f"utr{n}": X.within_utr(exons, strand, F.col(f"cds_start{n}"), F.col(f"cds_end{n}"), at),
                f"start{n}": F.array_min(F.transform(exons, lambda e: e["start"])),
                f"end{n}": F.array_max(F.transform(exons, lambda e: e["end"])),
            }
        )
    inside = lambda n, o: (F.col("chrom1") == F.col("chrom2")) & F.col(f"break{n}").between(F.col(f"start{o}"), F.col(f"end{o}"))
    return rows.withColumns({"in_other1": inside(1, 2), "in_other2": inside(2, 1)})


def extents(transcripts: DataFrame) -> DataFrame:
    """(gene, chrom, strand, start, end, coding) of genes."""
    first, last = F.array_min(F.transform("exons", lambda e: e["start"])), F.array_max(F.transform("exons", lambda e: e["end"]))
    return transcripts.groupBy("gene", "chrom", "strand").agg(F.min(first).alias("start"), F.max(last).alias("end"), F.bool_or("coding").alias("coding"))


def events(segments: DataFrame, transcripts: DataFrame, contigs: DataFrame, on_genome: bool = False, external: DataFrame | None = None, **rules) -> DataFrame:
    """One row for each pair of consecutive segments of a contig, with its label and the reason why it is rejected, null for the good.

    ``segments``: alignments to transcripts, target a tid; or to the genome, with blocks, if ``on_genome``. ``external`` (query, genes, state): what another
    mapping says of contigs, see ``operators.fusion.agreeing``. ``rules`` are those of ``operators.fusion.rejected``.
    """
    spans = segments.select("seg_id", "query", "target", "strand", "qstart", "qend", "tstart", "tend") if on_genome else segments
    pairs = S.junction_sequences(S.classify(S.consecutive(spans), sort=False, transcript=True), contigs)
    rows = located_on_genome(pairs, segments, transcripts) if on_genome else located(pairs, transcripts)
    if external is not None:
        rows = U.agreeing(rows.join(U.genes_of(rows.select("query", F.col("gene1").alias("gene")), rows), "query"), external).drop("genes")
    seqs = contigs.select(F.col("name").alias("_name"), F.col("seq").alias("_seq"))
    rows = rows.join(seqs, F.col("query") == F.col("_name")).withColumn("probe", balanced_probe(F.col("_seq"), F.col("cb1"), F.col("cb2"))).drop("_name", "_seq")
    fusion = F.col("gene1") != F.col("gene2")
    label = U.within_gene(F.when(fusion, "fusion").otherwise(F.col("rearrangement")), F.col("coding1") & F.col("coding2"), F.col("utr1"), F.col("utr2"), F.col("bound1"), F.col("bound2"))
    feature = F.when(F.col("utr1").isNotNull() | F.col("utr2").isNotNull(), "UTR").otherwise("exon")
    sense = U.sense_by_genome(F.col("strand1"), F.col("orient1"), F.col("strand2"), F.col("orient2")) if on_genome else U.sense_by_transcripts(F.col("align_strand1"), F.col("align_strand2"))
    rows = rows.withColumns({"event_id": F.col("seg1"), "event": label, "feature": feature, "upstream": sense})
    rows = U.read_throughs(rows, extents(transcripts))
    rows = rows.withColumn("event", F.when((F.col("event") == "fusion") & F.col("read_through"), "read_through").otherwise(F.col("event")))
    return U.rejected(rows, **rules)


def report(found: DataFrame, reads: DataFrame, fragments: DataFrame, least: int = 4) -> DataFrame:
    """Accepted events of ``events``, merged over contigs, with support, numbered in the order of the report."""
    good = found.where("reason is null")
    spans = good.select(F.col("query").alias("contig"), F.least("cb1", "cb2").alias("span1"), F.greatest("cb1", "cb2").alias("span2")).distinct()
    key = ["contig", "span1", "span2"]
    both = spans.join(R.spanning(spans, reads), key, "left").join(R.flanking(spans, fragments, enclose=False), key, "left").fillna(0, ["spanning", "flanking"])
    rows = R.with_support(good, both).withColumns({"seq_no": F.col("event_id"), "copies": F.lit(None).cast("int")})
    return U.ordered_report(U.merge(rows).where(F.col("spanning") >= least))


def unique_events(found: DataFrame, alignments: DataFrame) -> DataFrame:
    """Events without those whose sub-sequences (``operators.fusion.sub_sequences``) align whole to more than one canonical place. ``alignments`` of
    these: event_id, piece, target, matched, nm; lengths come with the pieces."""
    return found.join(U.multimapped(alignments), "event_id", "left_anti")


def with_rescued(segments: DataFrame, contigs: DataFrame, transcripts: DataFrame, best: DataFrame, external: DataFrame | None = None, on_genome: bool = True) -> DataFrame:
    """Segments of contigs with one partial alignment, and the ends that it leaves out where the transcript holds them once: pairs for ``events``.

    ``best``: seg_id, tid of the transcript of an alignment; ``transcripts``: tid, chrom, strand, exons, seq.
    """
    ends = unaligned_ends(segments, contigs, external).join(best.select("seg_id", "tid"), "seg_id")
    new = rescued(ends, transcripts, on_genome)
    block = F.array(F.struct(F.col("tstart").alias("ts"), F.col("tend").alias("te"), F.when(F.col("strand") == "+", F.col("qstart")).otherwise(F.col("qend")).alias("qs"), F.when(F.col("strand") == "+", F.col("qend")).otherwise(F.col("qstart")).alias("qe")))
    cols = ["seg_id", "query", "target", "strand", "qstart", "qend", "tstart", "tend", "blocks"]
    rows = new.withColumn("blocks", block).withColumn("seg_id", -F.col("seg_id") * 2 - F.when(F.col("side") == "start", 0).otherwise(1))  # ids of their own
    old = segments.join(new.select("query").distinct(), "query", "left_semi")
    return old.select(*cols).union(rows.select(*cols))
