"""Novel splicing linked to variants of the genome at its splice sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.splice import interrupted, matching_calls
from ..operators.support import alternative_base, pileup

CHANGED = ("novel_acceptor", "novel_donor", "retained_intron", "novel_intron", "novel_exon")
UNUSED = ("skipped_exon", "novel_acceptor", "novel_donor")


def _sites(events: DataFrame) -> DataFrame:
    return events.select("event_id", "chrom", F.posexplode("sites").alias("nth", "s")).select("event_id", "nth", "chrom", F.col("s.pos").alias("pos"), F.upper("s.base").alias("base"))


def _joined(rows: DataFrame, *names: str) -> DataFrame:
    """One row for each event, each column's texts joined by commas in the order of sites."""
    each = rows.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("nth", *names))).alias("m"))
    return each.select("event_id", *[F.array_join(F.col(f"m.{n}"), ",").alias(n) for n in names])


def corroborated(events: DataFrame, reads: DataFrame | None = None, calls: DataFrame | None = None) -> DataFrame:
    """Adds variant and genome_support, both null where the genome says nothing.

    Events whose motif is not canonical and follows from a substitution (sites: pos and the base wanted) are supported by reads or calls with
    that base; events that leave a canonical site unused (sites: its four positions with the reference's bases) by reads or calls that
    interrupt one. ``events``: event_id, event, chrom, motif, sites. ``reads``: chrom, blocks, seq. ``calls``: vchrom, vpos, ref, alt, ad, dp. Reads go before calls.
    """
    canonical, some = F.col("motif").isin("GTAG", "AGGT"), F.size("sites") > 0
    changed = events.where(F.col("event").isin(*CHANGED) & (F.col("motif") != "GTAG") & some)
    unused = events.where(F.col("event").isin(*UNUSED) & canonical & (F.size("sites") == 4))
    none = F.lit(None).cast("string")
    a, b = _sites(changed), _sites(unused)
    named = F.concat(F.col("chrom"), F.lit(":"), F.col("pos"), F.col("base"), F.lit(">"), F.col("alt"))
    if reads is not None:
        counts = pileup(a.select("chrom", "pos").union(b.select("chrom", "pos")), reads)
        total = counts.groupBy("chrom", "pos").agg(F.sum("n").alias("total"))
        own = a.join(counts, ["chrom", "pos", "base"], "left").join(total, ["chrom", "pos"], "left")
        own = own.withColumn("genome_support", F.concat_ws("/", F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0)))).withColumn("variant", none)
        other = alternative_base(counts.join(b.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi"), b.select("chrom", "pos", F.col("base").alias("ref")).distinct())
        cut = b.join(other.select("chrom", "pos", F.col("base").alias("alt"), "n", "coverage"), ["chrom", "pos"]).withColumns({"genome_support": F.concat_ws("/", "n", "coverage"), "variant": named})
    elif calls is not None:
        own = a.withColumn("site_id", F.struct("event_id", "nth"))
        own = matching_calls(own, calls).select("site_id.event_id", "site_id.nth", "genome_support", none.alias("variant"))
        near = interrupted(b.withColumn("site_id", F.struct("event_id", "nth", "base")), calls)
        spans = (F.col("vpos") <= F.col("pos")) & (F.col("vpos") + F.length("ref") - 1 >= F.col("pos"))
        one = (F.col("vpos") == F.col("pos")) & (F.length("ref") == 1)
        where = F.when(one, F.concat(F.col("pos"), F.col("site_id.base"))).otherwise(F.concat(F.col("vpos"), F.lit("-"), F.col("vpos") + F.length("ref") - 1, F.col("ref")))
        cut = near.where(spans).select("site_id.event_id", "site_id.nth", "genome_support", F.concat(F.col("chrom"), F.lit(":"), where, F.lit(">"), F.upper("alt")).alias("variant"))
    else:
        return events.withColumns({"variant": none, "genome_support": none})
    found = _joined(own.select("event_id", "nth", "variant", "genome_support").withColumn("variant", F.coalesce("variant", F.lit(""))), "variant", "genome_support").withColumn("variant", none)
    found = found.unionByName(_joined(cut.select("event_id", "nth", "variant", "genome_support"), "variant", "genome_support"))
    found = found.groupBy("event_id").agg(F.max("variant").alias("variant"), F.max("genome_support").alias("genome_support"))  # an event is in one of the two
    return events.join(found, "event_id", "left")
