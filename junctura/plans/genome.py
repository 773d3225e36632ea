"""Structural variants of a genome from alignments of assembled contigs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions.sequences import probe
from ..lineage import cut
from ..operators import adjacency as A
from ..operators import chimeras as X
from ..operators import segments as S
from ..operators import support as R
from ..operators import variants as V
from ..operators.intervals import overlap_join, without_overlap
from ..sinks.vcf import variant_records
from . import refilter


def chimeras(segments: DataFrame, check_alternatives: bool = True) -> DataFrame:
    """The segments that make up each chimeric contig, with ``dubious``: whether any of them can be replaced by other alignments.

    The best chain of primaries from end to end; where it lies on several targets, two alignments to one target if there are such. Contigs
    that other alignments chain at least as well say nothing. Others on haplotypes count only for the swap.
    """
    rows = cut(S.chimera_candidates(segments))
    first = rows.where("is_primary")
    whole = S.best_path(S.paths(first)).select("query", F.explode("path").alias("seg_id"))  # from end to end, or the contig says nothing
    members, others = first.join(whole, ["query", "seg_id"], "left_semi"), rows.where("not is_primary")
    members = cut(X.swapped(members, others, X.same_target(members, others)))
    others = cut(X.canonical(others))
    members = members.join(X.outdone(members, others), "query", "left_anti")
    if not check_alternatives:
        return members.withColumn("dubious", F.lit(False))
    doubt = X.replaceable(members, others).select("query").distinct().withColumn("dubious", F.lit(True))
    return members.join(doubt, "query", "left").withColumn("dubious", F.coalesce("dubious", F.lit(False)))


def events(
    alignments: DataFrame, contigs: DataFrame, least_size: int | None = None, most_size: int | None = None, least_contig: int = 0, skip: DataFrame | None = None, check_alternatives: bool = True,
) -> DataFrame:
    """Adjacencies, one row for each contig, from split and from gapped alignments; the input of ``operators.adjacency.merge``.

    ``least_contig``: shorter contigs are left out, as are those of ``skip`` (name). ``dubious`` marks events of contigs that other
    alignments may explain, unless ``check_alternatives`` is off.
    """
    contigs = contigs.where(F.length("seq") >= least_contig)
    if skip is not None:
        contigs = contigs.join(skip.select("name").distinct(), "name", "left_anti")
    alignments = alignments.join(contigs.select(F.col("name").alias("query")).distinct(), "query", "left_semi")
    segments = S.to_segments(S.primary_split(alignments)).withColumns({"seg_id": F.col("seq_no"), "edits": C.effective_edits(F.col("nm"), F.col("cigar"))})
    split = cut(chimeras(segments, check_alternatives))
    pairs = S.junction_sequences(S.classify(S.consecutive(split.select("seg_id", "query", "target", "strand", "qstart", "qend", "tstart", "tend"))), contigs)
    pairs = pairs.join(split.select("query", "dubious").distinct(), "query")
    side = lambda k: split.select("query", F.col("seg_id").alias(f"seg{k}"), F.col("tstart").alias(f"_s{k}"), F.col("tend").alias(f"_e{k}"))
    pairs = pairs.join(side(1), ["query", "seg1"]).join(side(2), ["query", "seg2"])
    pick = lambda a, b, name: F.when(F.col("swapped"), F.col(b)).otherwise(F.col(a)).alias(name)
    spans = [pick("_s1", "_s2", "span1_start"), pick("_e1", "_e2", "span1_end"), pick("_s2", "_s1", "span2_start"), pick("_e2", "_e1", "span2_end")]
    none = lambda kind: F.lit(None).cast(kind)
    repeats = ("repeat_seq", "string"), ("repeat_num", "int"), ("repeat_change", "string")
    single = S.to_segments(S.unique_alignments(alignments)).withColumn("seg_id", F.col("seq_no"))
    gapped = S.gapped_indels(single, contigs)
    a = pairs.select("query", "rearrangement", "chrom1", "break1", "orient1", "chrom2", "break2", "orient2", "cb1", "cb2", "homol_seq", "novel_seq", F.lit("split").alias("align_type"), F.col("seg1").alias("seq_no"), "dubious", "strand1", "strand2", "homol1", "homol2", *spans, *[none(t).alias(c) for c, t in repeats])
    b = gapped.select("query", "rearrangement", F.col("target").alias("chrom1"), "break1", F.lit("L").alias("orient1"), F.col("target").alias("chrom2"), "break2", F.lit("R").alias("orient2"), "cb1", "cb2", F.lit(None).cast("string").alias("homol_seq"), "novel_seq", F.lit("gapped").alias("align_type"), F.col("seg_id").alias("seq_no"), F.lit(False).alias("dubious"),
        F.col("strand").alias("strand1"), F.col("strand").alias("strand2"), none("bigint").alias("homol1"), none("bigint").alias("homol2"), *[none("bigint").alias(f"span{n}_{x}") for n in (1, 2) for x in ("start", "end")], *[F.col(c).cast(t) for c, t in repeats])
    rows = A.sane(a.union(b))
    rows = rows.join(contigs.select(F.col("name").alias("query"), "seq"), "query").withColumn("probe", probe(F.col("seq"), F.col("cb1"), F.col("cb2"))).drop("seq")
    n = A.size(F.col("rearrangement"), F.col("break1"), F.col("break2"), F.col("novel_seq"), F.col("align_type") == "gapped")
    return A.within_size(rows.withColumn("size", n), least_size, most_size)


def merged(found: DataFrame) -> DataFrame:
    """Adjacencies (adj_id and the columns of the event): events of several contigs once, with what the first contig says of sequences,
    repeats, strands and spans, all contigs and their breaks as lists joined by commas, and the support of all.

    ``found``: from ``events``, with or without spanning and flanking.
    """
    said = ["probe", "homol1", "homol2", "align_type", "dubious", "size", "homol_seq", "novel_seq", "strand1", "strand2", "span1_start", "span1_end", "span2_start", "span2_end", "repeat_seq", "repeat_num", "repeat_change"]
    counts = [c for c in ("spanning", "flanking") if c in found.columns]
    rows = A.merge(found, extra=[*said, *counts])
    first = F.get("members", F.lit(0))
    every = lambda c: F.array_join(F.transform("members", lambda m: m[c].cast("string")), ",")
    total = lambda c: F.aggregate("members", F.lit(0).cast("bigint"), lambda a, m: a + m[c]).cast("int")
    own = {c: first[c] for c in (*said, "contig", "cb1", "cb2")} | {"contigs": every("contig"), "cb1s": every("cb1"), "cb2s": every("cb2"), "overlaps": first["cb1"] >= first["cb2"]}
    return rows.withColumns(own | {c: total(c) for c in counts}).drop("members")


def supported_events(found: DataFrame, reads: DataFrame, fragments: DataFrame, least: int = 2) -> DataFrame:
    """Events with the spanning reads and flanking pairs of their contig spans, of which at least ``least`` span."""
    spans = found.select(F.col("query").alias("contig"), F.least("cb1", "cb2").alias("span1"), F.greatest("cb1", "cb2").alias("span2")).distinct()
    key = ["contig", "span1", "span2"]
    both = spans.join(R.spanning(spans, reads), key, "left").join(R.flanking(spans, fragments), key, "left").fillna(0, ["spanning", "flanking"])
    return R.with_support(found, both).where(F.col("spanning") >= least)


def variants(merged: DataFrame) -> DataFrame:
    """Variants of merged adjacencies that carry dubious, align_type, contig and the spans of their aligned segments."""
    return V.assemble(merged)


def with_bases(adjacencies: DataFrame, bases: DataFrame) -> DataFrame:
    """Adjacencies with ref1 and ref2, the bases at their breaks. ``bases``: chrom, start and seq, pieces of the reference that do not overlap."""
    places = adjacencies.select(F.explode(F.array(*[F.struct(F.col(f"chrom{n}").alias("chrom"), F.col(f"break{n}").alias("pos")) for n in (1, 2)])).alias("p")).select("p.chrom", F.col("p.pos").alias("_from"), F.col("p.pos").alias("_to")).distinct()
    pieces = bases.select(F.col("chrom").alias("_chrom"), "start", (F.col("start") + F.length("seq") - 1).alias("_end"), "seq")
    base = F.upper(F.substr(F.col("seq"), (F.col("_from") - F.col("start") + 1).cast("int"), F.lit(1)))
    known = cut(overlap_join(places, pieces, [("chrom", "_chrom")], ("_from", "_to"), ("start", "_end"), 100_000).select("chrom", "_from", base.alias("_base")))
    for n in ("1", "2"):
        adjacencies = adjacencies.join(known.select(F.col("chrom").alias(f"chrom{n}"), F.col("_from").alias(f"break{n}"), F.col("_base").alias(f"ref{n}")), [f"chrom{n}", f"break{n}"], "left")
    return adjacencies


def records(adjacencies: DataFrame, variants: DataFrame, bases: DataFrame, threshold: int = 100) -> DataFrame:
    """VCF records of variants of merged adjacencies (with spanning and flanking); deletions of up to ``threshold`` bases are spelled out where ``bases``
    hold them in one piece."""
    rows = with_bases(adjacencies, bases)
    short = rows.where("rearrangement = 'del'").where(F.col("size") <= threshold).select("adj_id", "chrom1", F.col("break1").alias("_from"), (F.col("break2") - 1).alias("_to"))
    pieces = bases.select(F.col("chrom").alias("_chrom"), "start", (F.col("start") + F.length("seq") - 1).alias("_end"), "seq")
    whole = overlap_join(short, pieces, [("chrom1", "_chrom")], ("_from", "_to"), ("start", "_end"), 100_000).where("start <= _from and _end >= _to")
    spelled = whole.select("adj_id", F.substr(F.col("seq"), (F.col("_from") - F.col("start") + 1).cast("int"), (F.col("_to") - F.col("_from") + 1).cast("int")).alias("ref_seq"))
    return variant_records(variants, rows.join(spelled, "adj_id", "left"), threshold)


class Found(NamedTuple):
    """What ``analyse`` gives: adjacencies (contig, cb1 and cb2 are lists joined by commas), variants and VCF records, before and after the filter by support."""

    adjacencies: DataFrame
    variants: DataFrame
    records: DataFrame
    supported_adjacencies: DataFrame | None = None
    supported_variants: DataFrame | None = None
    supported_records: DataFrame | None = None


def analyse(
    alignments: DataFrame, contigs: DataFrame, bases: DataFrame, reads: DataFrame | None = None, fragments: DataFrame | None = None, bad: DataFrame | None = None, centromeres: DataFrame | None = None,
    realignments: DataFrame | None = None, most_homology: int = 25, least: int = 2, threshold: int = 100, buffer: int = 1, **options,
) -> Found:
    """From alignments of contigs to variants and their records.

    ``bad``, ``centromeres``: chrom, start, stop. Contigs with an alignment in a centromere and adjacencies with a break in a bad region are left out; so are variants
    with unsound sequences (``sound_variants``) or, given ``realignments`` (query, cigar, unmapped) of probes by the name of the adjacency's first contig
    and its id (contig.id), those whose probes align elsewhere. ``reads`` and ``fragments`` (as in ``operators.support``) give the supported tables, whose variants
    have at least ``least`` spanning reads for each adjacency. ``options`` go to ``events``.
    """
    if centromeres is not None:
        spans = S.to_segments(alignments.where(F.col("target").isNotNull())).select("query", "target", "tstart", "tend")
        clean = without_overlap(spans, centromeres.select("chrom", F.col("start").alias("_first"), F.col("stop").alias("_last")), [("target", "chrom")], ("tstart", "tend"), ("_first", "_last"), ["query"])
        alignments = alignments.join(clean.select("query").distinct(), "query", "left_semi")
    rows = cut(merged(events(alignments, contigs, **options)))
    if bad is not None:
        breaks = rows.select("adj_id", F.explode(F.array(*[F.struct(F.col(f"chrom{n}").alias("_c"), F.col(f"break{n}").alias("_p")) for n in (1, 2)])).alias("b")).select("adj_id", "b._c", "b._p", F.col("b._p").alias("_q"))
        kept = without_overlap(breaks, bad.select("chrom", F.col("start").alias("_first"), F.col("stop").alias("_last")), [("_c", "chrom")], ("_p", "_q"), ("_first", "_last"), ["adj_id"])
        rows = rows.join(kept.select("adj_id").distinct(), "adj_id", "left_semi")
    found = A.sound_variants(V.assemble(rows), rows, most_homology)
    if realignments is not None:
        named = realignments.withColumn("adj_id", F.element_at(F.split("query", "[.]"), -1).cast("bigint")).select("adj_id", "cigar", "unmapped")
        found = V.without_realigned(found, rows, named)
    found = cut(found)
    rows = cut(rows.join(found.select(F.explode("adj_ids").alias("adj_id")).distinct(), "adj_id", "left_semi"))
    unknown = rows.withColumns({c: F.lit(None).cast("int") for c in ("spanning", "flanking")})
    listed = lambda t: V.as_insertions(t, found).drop("contig", "cb1", "cb2").withColumnsRenamed({"contigs": "contig", "cb1s": "cb1", "cb2s": "cb2"})
    out = Found(listed(rows), found, records(unknown, found, bases, threshold))
    if reads is None or fragments is None:
        return out
    parts = F.explode(F.arrays_zip(F.split("contigs", ",").alias("c"), F.split("cb1s", ",").alias("a"), F.split("cb2s", ",").alias("b"))).alias("p")
    spans = rows.select(parts).select(F.col("p.c").alias("contig"), F.col("p.a").cast("bigint").alias("a"), F.col("p.b").cast("bigint").alias("b"))
    spans = spans.select("contig", F.least("a", "b").alias("span1"), F.greatest("a", "b").alias("span2")).distinct()
    key = ["contig", "span1", "span2"]
    support = cut(spans.join(R.spanning(spans, reads, buffer), key, "left").join(R.flanking(spans, fragments, buffer), key, "left").fillna(0, ["spanning", "flanking"]))
    counted = cut(refilter.support_of(listed(rows), support))
    passed = cut(refilter.variants_passed(found, counted, least))
    kept = rows.join(counted.select("adj_id", "spanning", "flanking"), "adj_id").join(passed.select(F.explode("adj_ids").alias("adj_id")).distinct(), "adj_id", "left_semi")
    return out._replace(supported_adjacencies=counted.join(kept.select("adj_id"), "adj_id", "left_semi"), supported_variants=passed, supported_records=records(kept, passed.drop("spanning", "flanking"), bases, threshold))
