"""Novel splicing: events of junctions, motifs, and what removes or corroborates them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import reverse_complement
from .intervals import band_join


def motif_of(donor: Column, acceptor: Column, strand: Column, distance: Column, most: int = 1) -> Column:
    """(motif, donor_diffs, acceptor_diffs) of two genome dinucleotides against GT and AG on the transcript's strand; null unless at
    most ``most`` bases differ, at most one at each site, and the sites begin at least 3 bases apart."""
    own = lambda c: F.upper(F.when(strand == "-", reverse_complement(c)).otherwise(c))
    differ = lambda c, want: F.filter(F.array(F.lit(1), F.lit(2)), lambda i: F.substr(own(c), i, F.lit(1)) != F.substr(F.lit(want), i, F.lit(1)))
    d, a = differ(donor, "GT"), differ(acceptor, "AG")
    good = (distance >= 3) & (F.size(d) <= 1) & (F.size(a) <= 1) & (F.size(d) + F.size(a) <= most)
    return F.when(good, F.struct(F.concat(own(donor), own(acceptor)).alias("motif"), d.alias("donor_diffs"), a.alias("acceptor_diffs")))


def implied_variants(chrom: Column, strand: Column, donor: Column, acceptor: Column, donor_start: Column, acceptor_start: Column, motif: Column) -> Column:
    """The substitutions that would make a motif canonical: chrom:posFROM>TO, on the forward strand."""
    def one(seq: Column, start: Column, diffs: Column, want: str) -> Column:
        forward = strand == "+"
        place = lambda i: F.when(forward, start + i - 1).otherwise(start + 2 - i)
        had = lambda i: F.upper(F.substr(seq, F.when(forward, i).otherwise(3 - i), F.lit(1)))
        new = lambda i: F.when(forward, F.substr(F.lit(want), i, F.lit(1))).otherwise(reverse_complement(F.substr(F.lit(want), i, F.lit(1))))
        return F.transform(diffs, lambda i: F.concat(chrom, F.lit(":"), place(i), had(i), F.lit(">"), new(i)))

    return F.when(motif.isNotNull(), F.concat(one(donor, donor_start, motif["donor_diffs"], "GT"), one(acceptor, acceptor_start, motif["acceptor_diffs"], "AG")))


def _two_ends(bases: Column) -> tuple[Column, Column]:
    return F.upper(F.left(bases, F.lit(2))), F.upper(F.right(bases, F.lit(2)))


def retained_intron_motif(chrom: Column, pos1: Column, pos2: Column, contig: Column, genome: Column, strand: Column, most: int = 1) -> Column:
    """For the two ends of a retained intron, lower end first: an array of (motif, variant), the motif as the contig has it on the
    transcript's strand, and chrom:posFROM>TO where it differs from the genome. Null where more than ``most`` bases differ, or two at one end.

    ``contig`` and ``genome``: the bases between the exons that end at ``pos1`` and begin at ``pos2``, both on the forward strand.
    """
    parts = []
    for had, now, start in zip(_two_ends(genome), _two_ends(contig), (pos1 + 1, pos2 - 2), strict=True):
        diffs = F.filter(F.array(F.lit(1), F.lit(2)), lambda i: F.substr(had, i, F.lit(1)) != F.substr(now, i, F.lit(1)))  # noqa: B023
        i = F.get(diffs, F.lit(0))
        variant = F.when(F.size(diffs) > 0, F.concat(chrom, F.lit(":"), start + i - 1, F.substr(had, i, F.lit(1)), F.lit(">"), F.substr(now, i, F.lit(1))))
        parts.append((F.size(diffs), F.struct(F.when(strand == "-", reverse_complement(now)).otherwise(now).alias("motif"), variant.alias("variant"))))
    (n1, one), (n2, two) = parts
    return F.when((n1 <= 1) & (n2 <= 1) & (n1 + n2 <= most) & (F.length(contig) >= 2) & (F.length(genome) >= 2), F.array(one, two))


def skipped_exon_sites(exons: Column, strand: Column, exon1: Column, exon2: Column) -> Column:
    """The four intron positions next to the lowest exon between two exon numbers: two before it, two after; null if there is none."""
    n = F.size(exons)
    low, high = F.least(exon1, exon2) + 1, F.greatest(exon1, exon2) - 1
    index = F.when(strand == "-", n - high).otherwise(low - 1)  # the lowest in the genome
    x = F.get(exons, index.cast("int"))
    return F.when((high >= low) & (low >= 1) & (high <= n), F.array(x["start"] - 2, x["start"] - 1, x["end"] + 1, x["end"] + 2))


def novel_site_positions(exons: Column, strand: Column, exon1: Column, exon2: Column) -> Column:
    """The four positions of the splice sites of the intron between two exons (by number): the first two of it, and the last two."""
    n = F.size(exons)
    at = lambda k: F.get(exons, F.when(strand == "-", n - k).otherwise(k - 1).cast("int"))
    a, b = at(exon1), at(exon2)
    first, second = F.when(a["start"] <= b["start"], a).otherwise(b), F.when(a["start"] <= b["start"], b).otherwise(a)
    return F.when(a.isNotNull() & b.isNotNull(), F.array(first["end"] + 1, first["end"] + 2, second["start"] - 2, second["start"] - 1))


def site_motif(bases: Column, strand: Column) -> Column:
    """The motif of four bases at ascending positions on the forward strand; on the reverse strand each pair is complemented, the pairs keep
    their order."""
    low, high = F.left(bases, F.lit(2)), F.right(bases, F.lit(2))
    return F.upper(F.when(strand == "-", F.concat(reverse_complement(low), reverse_complement(high))).otherwise(bases))


def canonical_sites(events: DataFrame, genome: DataFrame, chunk: int) -> DataFrame:
    """Adds sites (array of position and base) and site_bases to skipped exons and to novel donors and acceptors: the bases of the genome
    whose change would explain the event, as ``matching_calls`` and ``interrupted`` look for them; null for other events.

    ``events``: event_id, event, chrom, strand, exons, number1, number2 (exon numbers); ``genome``: a FASTA in chunks of ``chunk`` bases.
    """
    from ..sources.text import fetch

    args = F.col("exons"), F.col("strand"), F.col("number1"), F.col("number2")
    places = F.when(F.col("event") == "skipped_exon", skipped_exon_sites(*args)).when(F.col("event").isin("novel_donor", "novel_acceptor"), novel_site_positions(*args))
    rows = events.withColumn("_places", places)
    each = rows.where("_places is not null").select("event_id", "chrom", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.col("_places")[0].alias("at")), F.struct(F.lit(1).alias("n"), F.col("_places")[2].alias("at")))).alias("s"))
    each = each.select("event_id", "chrom", F.col("s.n").alias("n"), F.col("s.at").alias("start"), (F.col("s.at") + 1).alias("end"))
    got = fetch(each, genome, chunk, ["event_id", "n"]).groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "seq"))), lambda x: x["seq"]), "").alias("_bases"))  # two rows each
    rows = rows.join(got, "event_id", "left")
    sites = F.when(F.length("_bases") == 4, F.transform("_places", lambda p, i: F.struct(p.alias("pos"), F.upper(F.substr("_bases", i + 1, F.lit(1))).alias("base"))))
    return rows.select(*events.columns, sites.alias("sites"), F.when(F.length("_bases") == 4, site_motif(F.col("_bases"), F.col("strand"))).alias("site_bases"))


def classify(junctions: DataFrame, least_intron: int = 20) -> DataFrame:
    """Events of junctions between two blocks: one row for each rule that fits.

    ``junctions``: strand, block1_end, block2_start, exon1, code1, exon2, code2, exon1_end, exon2_start (of the matched exons), skipped (bases
    of the exons between), known (an annotated junction) and motif (whether the splice motif is there). A null code1 means no exon
    before. Known junctions give no event.
    """
    gap = F.col("block2_start") - F.col("block1_end") - 1
    c1, c2, forward = F.col("code1"), F.col("code2"), F.col("strand") == "+"
    right, left = F.substr(c1, F.lit(2), F.lit(1)), F.substr(c2, F.lit(1), F.lit(1))
    both = c1.isNotNull() & c2.isNotNull()
    new = lambda test, event, n: F.when(test, F.struct(event.alias("event"), n.cast("bigint").alias("size")))
    intron = F.when((gap > least_intron) & F.col("motif"), "novel_intron").when(gap > 0, "del").when(gap == 0, "ins")
    events = F.array(
        new(c1.isNull() & (F.col("exon2") == 0) & (c2 == "<=") & (gap > 0), intron, gap),
        new(both & (F.col("exon2") > F.col("exon1") + 1), F.lit("skipped_exon"), F.col("skipped")),
        new(both & (F.col("exon1") == F.col("exon2")) & (right == "<") & (left == ">") & (gap >= 0), intron, gap),
        new(both & (left != "=") & F.col("motif"), F.when(forward, "novel_acceptor").otherwise("novel_donor"), F.abs(F.col("block2_start") - F.col("exon2_start"))),
        new(both & (right != "=") & F.col("motif"), F.when(forward, "novel_donor").otherwise("novel_acceptor"), F.abs(F.col("block1_end") - F.col("exon1_end"))),
    )
    rows = junctions.where("not known").withColumn("_e", F.explode(F.filter(events, lambda e: e.isNotNull())))
    return rows.select(*junctions.columns, F.col("_e.event").alias("event"), F.col("_e.size").alias("size")).where("event not in ('ins', 'del')")


def retained_introns(mapped: DataFrame, known: DataFrame, width: int = 10_000) -> DataFrame:
    """Introns that lie inside one block: (seg_id, tid, block, exon1, exon2, pos1, pos2, size), but those within a known exon.

    A block that matches two exons needs one outer bound that matches; of more exons each pair in a row counts.
    """
    from .intervals import overlap_join

    rows = mapped.select("seg_id", "target", "tid", "exons", F.posexplode("codes").alias("block", "m")).where("size(m) > 1")
    outer = ((F.get("m", F.lit(0))["code"] == "=>") & F.startswith(F.get("m", F.lit(1))["code"], F.lit("<"))) | (F.endswith(F.get("m", F.lit(0))["code"], F.lit(">")) & (F.get("m", F.lit(1))["code"] == "<="))
    rows = rows.where((F.size("m") > 2) | outer)
    pair = F.explode(F.arrays_zip(F.slice("m", 1, F.size("m") - 1).alias("a"), F.slice("m", 2, F.size("m") - 1).alias("b")))
    rows = rows.select("seg_id", "target", "tid", "exons", "block", pair.alias("p")).where("p.b.exon = p.a.exon + 1 and p.a.code like '_>' and p.b.code like '<_'")
    found = rows.select("seg_id", "target", "tid", "block", F.col("p.a.exon").alias("exon1"), F.col("p.b.exon").alias("exon2"), F.get("exons", F.col("p.a.exon"))["end"].alias("pos1"), F.get("exons", F.col("p.b.exon"))["start"].alias("pos2"))
    k = known.select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    inside = overlap_join(found, k, [("target", "_c")], ("pos1", "pos2"), ("_s", "_e"), width).where("_s <= pos1 and _e >= pos2").select("target", "pos1", "pos2").distinct()
    return found.join(inside, ["target", "pos1", "pos2"], "left_anti").withColumn("size", F.col("pos2") - F.col("pos1") - 1)


def split_in_two(events: DataFrame) -> DataFrame:
    """Novel exons and retained introns as two linked rows, part 1 and 2; others as they are, part null. link_id joins the two."""
    two = F.col("event").isin("novel_exon", "retained_intron")
    parts = F.explode(F.when(two, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(None).cast("int"))))
    return events.withColumn("part", parts).withColumn("link_id", F.when(two, F.col("event_id")))


def supported(events: DataFrame, least: int = 4) -> DataFrame:
    """Events with at least ``least`` spanning reads; one that fails takes its linked partner along. Events without a link get a second key that
    spreads them, else all of them would meet in one task of the join."""
    spread = F.xxhash64("link_id")
    failed = events.where((F.col("spanning") < least) & F.col("link_id").isNotNull()).select("link_id").distinct().withColumn("_spread", spread)
    rows = events.where(F.col("spanning") >= least).withColumn("_spread", F.when(F.col("link_id").isNotNull(), spread).otherwise(F.xxhash64(*events.columns)))
    return rows.join(failed, ["link_id", "_spread"], "left_anti").select(*events.columns)


def without_intron_sites(events: DataFrame) -> DataFrame:
    """Without novel donors and acceptors whose breaks equal those of a novel intron."""
    introns = events.where("event = 'novel_intron'").select("target", "pos1", "pos2").distinct().withColumn("_in", F.lit(True))
    rows = events.join(introns, ["target", "pos1", "pos2"], "left")
    return rows.where(~F.coalesce(F.col("_in") & F.col("event").isin("novel_donor", "novel_acceptor"), F.lit(False))).select(*events.columns)


def frame_by_size(size: Column) -> Column:
    """Whether an event keeps the reading frame; null without a size."""
    return size % 3 == 0


def interrupted(sites: DataFrame, calls: DataFrame, within: int = 500) -> DataFrame:
    """Sites (site_id, chrom, pos) with the variant calls (vchrom, vpos, ref, alt, ad, dp) at most ``within`` bases away, and their support."""
    rows = band_join(sites, calls, [("chrom", "vchrom")], "pos", "vpos", within)
    return rows.select("site_id", "chrom", "pos", "vpos", "ref", "alt", F.concat_ws("/", "ad", "dp").alias("genome_support"))


def matching_calls(sites: DataFrame, calls: DataFrame) -> DataFrame:
    """Sites (site_id, chrom, pos, base) with the calls of that base at that position."""
    return sites.join(calls, (F.col("chrom") == F.col("vchrom")) & (F.col("pos") == F.col("vpos")) & (F.upper("base") == F.upper("alt"))).select("site_id", "vpos", "alt", F.concat_ws("/", "ad", "dp").alias("genome_support"))
