"""Novel splicing from alignments of assembled contigs to a genome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import transcripts as X
from ..operators import exons as E
from ..operators import splice as P
from ..sources.text import fetch


def mapped(segments: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Each segment with its best transcript and the share of it that is covered."""
    best = E.best_transcripts(segments, transcripts)
    return best.withColumn("coverage", E.coverage(F.col("blocks"), F.col("exons")))


def known_junctions(annotations: dict[str, DataFrame]) -> DataFrame:
    """Junctions that any of several annotations (exon rows by name, as sources.text.gtf reads them) has, for ``novel_junctions``."""
    return E.annotated({name: rows.where("feature = 'exon'") for name, rows in annotations.items()})


def canonical_sites(events: DataFrame, genome: DataFrame, chunk: int) -> DataFrame:
    """Events of ``novel_junctions`` with the positions and bases of the splice sites that they leave unused, to look for variants at them."""
    n = lambda c: X.exon_number(F.col("exons"), F.col("strand"), F.col(c))
    rows = events.withColumns({"event_id": F.concat_ws(":", "seg_id", "event", "pos1", "pos2"), "number1": n("exon1"), "number2": n("exon2")}).withColumnRenamed("target", "chrom")
    return P.canonical_sites(rows, genome, chunk).withColumnRenamed("chrom", "target")


def novel_junctions(best: DataFrame, known: DataFrame, genome: DataFrame, chunk: int, most_diff: int = 1) -> DataFrame:
    """Events of the junctions between blocks, with motifs from a genome in chunks."""
    pairs = F.explode(F.arrays_zip(F.slice("blocks", 1, F.greatest(F.size("blocks") - 1, F.lit(0))).alias("b1"), F.slice("blocks", 2, F.greatest(F.size("blocks") - 1, F.lit(0))).alias("b2"), F.slice("codes", 1, F.greatest(F.size("codes") - 1, F.lit(0))).alias("m1"), F.slice("codes", 2, F.greatest(F.size("codes") - 1, F.lit(0))).alias("m2")))
    rows = best.select("seg_id", "query", F.col("target").alias("chrom"), "tid", "gene", F.col("tx_strand").alias("strand"), "exons", pairs.alias("p"))
    m1, m2 = F.element_at("p.m1", -1), F.get("p.m2", F.lit(0))
    rows = rows.select("seg_id", "query", "chrom", "tid", "gene", "strand", F.col("p.b1.te").alias("block1_end"), F.col("p.b2.ts").alias("block2_start"), F.col("p.b1.qe").alias("cb1"), F.col("p.b2.qs").alias("cb2"), m1["exon"].alias("exon1"), m1["code"].alias("code1"), m2["exon"].alias("exon2"), m2["code"].alias("code2"), "exons")
    between = F.filter("exons", lambda x, i: (i > F.col("exon1")) & (i < F.col("exon2")))
    rows = rows.withColumns({"exon1_end": F.get("exons", F.col("exon1"))["end"], "exon2_start": F.get("exons", F.col("exon2"))["start"], "skipped": F.aggregate(between, F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"] + 1)})
    rows = rows.where("code2 is not null")
    k = known.select("chrom", F.col("start").alias("block1_end"), F.col("end").alias("block2_start")).distinct().withColumn("_k", F.lit(True))
    rows = rows.join(k, ["chrom", "block1_end", "block2_start"], "left").withColumn("known", F.col("_k").isNotNull()).drop("_k")
    sites = rows.select("chrom", "block1_end", "block2_start").distinct()
    left = fetch(sites.select("chrom", "block1_end", "block2_start", (F.col("block1_end") + 1).alias("start"), (F.col("block1_end") + 2).alias("end")), genome, chunk, ["chrom", "block1_end", "block2_start"]).select("chrom", "block1_end", "block2_start", F.col("seq").alias("left_bases"))
    right = fetch(sites.select("chrom", "block1_end", "block2_start", (F.col("block2_start") - 2).alias("start"), (F.col("block2_start") - 1).alias("end")), genome, chunk, ["chrom", "block1_end", "block2_start"]).select("chrom", "block1_end", "block2_start", F.col("seq").alias("right_bases"))
    rows = rows.join(left, ["chrom", "block1_end", "block2_start"]).join(right, ["chrom", "block1_end", "block2_start"])
    forward = F.col("strand") == "+"
    donor, acceptor = F.when(forward, F.col("left_bases")).otherwise(F.col("right_bases")), F.when(forward, F.col("right_bases")).otherwise(F.col("left_bases"))
    found = P.motif_of(donor, acceptor, F.col("strand"), F.abs(F.col("block2_start") - 3 - F.col("block1_end")), most_diff)
    rows = rows.withColumn("splice", found).withColumn("motif", F.col("splice").isNotNull())
    return P.without_intron_sites(P.classify(rows).withColumnRenamed("chrom", "target").withColumns({"pos1": F.col("block1_end"), "pos2": F.col("block2_start")}))
