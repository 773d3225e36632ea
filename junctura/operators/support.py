"""Read support of contig spans: spanning reads, flanking pairs, totals and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .intervals import overlap_join


def fully_mapped(cigar: Column, pos: Column, contig_len: Column, clip_share: float | None = None) -> Column:
    """Reads without clips, or clipped only where the contig ends; with ``clip_share`` also soft clips on one side where that
    share of the read is aligned."""
    from ..functions.cigar import query_length, target_length

    clip = lambda k: F.coalesce(F.get(cigar, k)["op"].isin("S", "H"), F.lit(False))
    match = lambda k: F.coalesce(F.get(cigar, k)["op"] == "M", F.lit(False))
    n, zero, one, two = F.size(cigar), F.lit(0), F.lit(1), F.lit(2)
    last = pos + target_length(cigar) - 1 == contig_len
    edge = ((n == 2) & clip(zero) & match(one) & (pos == 1)) | ((n == 2) & match(zero) & clip(one) & last) | ((n == 3) & clip(zero) & match(one) & clip(two) & (pos == 1) & last)
    out = ~F.exists(cigar, lambda x: x["op"].isin("S", "H")) | edge
    if clip_share is not None:
        out = out | ((n == 2) & F.exists(cigar, lambda x: x["op"] == "S") & (target_length(cigar) >= clip_share * query_length(cigar)))
    return out


def accepted(reads: Column) -> Column:
    """How many of (seq_no, key, name), in order, are accepted: each reserves its key and its name, and one that finds either taken is
    not accepted."""
    return F.size(_accepted(reads))


def _accepted(reads: Column) -> Column:
    """Keys of the accepted reads."""
    kind = "array<string>"
    zero = F.struct(F.array().cast(kind).alias("keys"), F.array().cast(kind).alias("names"))

    def step(a: Column, x: Column) -> Column:
        free = ~F.array_contains(a["keys"], x["key"]) & ~F.array_contains(a["names"], x["name"])
        add = lambda old, new: F.when(free, F.array_append(old, new)).otherwise(old).cast(kind)
        return F.struct(add(a["keys"], x["key"]).alias("keys"), add(a["names"], x["name"]).alias("names"))

    return F.aggregate(F.sort_array(reads), zero, step, lambda a: a["keys"])


def spanning(spans: DataFrame, reads: DataFrame, buffer: int = 1, width: int = 500, contigs: DataFrame | None = None, layers: int = 3) -> DataFrame:
    """(contig, span1, span2, spanning): reads that reach ``buffer`` bases past both ends of a span and are fully mapped, of each start
    and strand and of each name the first one in file order.

    ``reads``: seq_no, name, contig, rstart, rend, strand, whole (fully mapped) and, to compare bases, seq and clip (clipped bases before
    its start). With ``contigs`` (name, seq) a read must equal the contig over the span. The order matters, so a span's reads are
    folded in order. Without ``contigs``, few reads of a start and strand are tried first (see ``_first_reads``): once one of them is accepted, the others of
    its key are refused. Only spans where none of a key's first ones is accepted look at all reads.
    """
    own = ["contig", "span1", "span2"]
    if contigs is None and "clip" not in reads.columns:
        found = cut(_spanning(spans, _first_reads(reads, layers), buffer, width, first=layers).where("spanning is not null"))
        rest = spans.select(*own).distinct().join(found.where("not sure").select(*own), own, "left_semi")
        found = found.where("sure").select(*own, "spanning")
        again = cut(rest)
        return found if again.isEmpty() else found.union(_spanning(again, reads, buffer, width).select(*own, "spanning"))
    return _spanning(spans, reads, buffer, width, contigs).select(*own, "spanning")


def _first_reads(reads: DataFrame, layers: int) -> DataFrame:
    """Of whole reads of one contig, start and strand, those that few earlier ones outreach, and ``more``: whether others of that key are left out. A read of a
    layer ends after all earlier ones of that layer and those behind it; so what is left out has at least ``layers`` earlier reads in every span that it is in."""
    key = Window.partitionBy("contig", "rstart", "strand")
    before = key.orderBy("seq_no", "name").rowsBetween(Window.unboundedPreceding, -1)
    rows = reads.where("whole and seq_no is not null and rstart <= rend").withColumn("_layer", F.lit(layers + 1))
    for k in range(1, layers + 1):
        behind = F.max(F.when(F.col("_layer") > layers, F.col("rend"))).over(before)
        rows = rows.withColumn("_reach", behind).withColumn("_layer", F.when((F.col("_layer") > layers) & (F.col("_reach").isNull() | (F.col("rend") > F.col("_reach"))), k).otherwise(F.col("_layer")))
    return rows.withColumn("more", F.max(F.col("_layer") > layers).over(key)).where(F.col("_layer") <= layers).drop("_layer", "_reach")


def _spanning(spans: DataFrame, reads: DataFrame, buffer: int, width: int, contigs: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """``spanning`` over all of ``reads``, and ``sure``: whether of each key that has ``more`` reads one is accepted. Of such
    keys only the ``first`` reads in a span count, which come before all that are left out."""
    wide = spans.select("contig", "span1", "span2", (F.col("span1") - buffer).alias("_s"), (F.col("span2") + buffer).alias("_e")).distinct()
    seen = reads.where("whole").withColumnRenamed("contig", "_contig")
    pairs = overlap_join(wide, seen, [("contig", "_contig")], ("_s", "_e"), ("rstart", "rend"), width).where("rstart <= _s and rend >= _e")
    if contigs is not None:
        pairs = pairs.join(contigs.select(F.col("name").alias("_contig2"), F.col("seq").alias("_cseq")), F.col("contig") == F.col("_contig2"))
        n = (F.col("_e") - F.col("_s") + 1).cast("int")
        own = F.substr(F.col("seq"), (F.col("_s") - F.col("rstart") + 1 + F.coalesce("clip", F.lit(0))).cast("int"), n)
        pairs = pairs.where(F.lower(own) == F.lower(F.substr(F.col("_cseq"), F.col("_s").cast("int"), n)))
    key = F.concat(F.when(F.coalesce("clip", F.lit(0)) > 0, -F.col("clip")).otherwise(F.col("rstart")), F.col("strand")) if "clip" in reads.columns else F.concat("rstart", "strand")
    more = F.coalesce(F.col("more"), F.lit(False)) if "more" in reads.columns else F.lit(False)
    rows = pairs.select("contig", "span1", "span2", "seq_no", key.alias("key"), "name", more.alias("more"))
    if first is not None:
        nth = F.row_number().over(Window.partitionBy("contig", "span1", "span2", "key").orderBy("seq_no", "name"))
        rows = rows.withColumn("_nth", nth).where(~F.col("more") | (F.col("_nth") <= first)).drop("_nth")
    # Of one name at one place only the first can be accepted.
    rows = rows.groupBy("contig", "span1", "span2", "key", "name").agg(F.min("seq_no").alias("seq_no"), F.max("more").alias("more"))
    # A read whose name lies under no other key of its span can be refused only for its key, and once such a read has come, its key
    # is taken; so all reads of the key after the first such one change nothing and go.
    own = ["contig", "span1", "span2"]
    alone = F.count("*").over(Window.partitionBy(*own, "name")) == 1
    taken = F.min(F.when(F.col("_alone"), F.col("seq_no"))).over(Window.partitionBy(*own, "key"))
    rows = rows.withColumn("_alone", alone).withColumn("_taken", taken).where("_taken is null or seq_no <= _taken")
    one = F.struct("seq_no", "key", "name")
    folded = rows.groupBy("contig", "span1", "span2").agg(F.collect_list(one).alias("reads"), F.collect_set(F.when(F.col("more"), F.col("key"))).alias("open"))
    folded = folded.select("contig", "span1", "span2", "open", F.explode(F.array(_accepted(F.col("reads")))).alias("keys"))
    return folded.select("contig", "span1", "span2", F.size("keys").alias("spanning"), (F.size(F.array_except("open", "keys")) == 0).alias("sure"))


def flanking(spans: DataFrame, fragments: DataFrame, buffer: int = 1, width: int = 500, enclose: bool = True) -> DataFrame:
    """(contig, span1, span2, flanking): distinct inner fragments (inner1, inner2), from the end of a read to the start of its mate, that
    enclose a span, or else that have an end inside it."""
    own = spans.select("contig", "span1", "span2", (F.col("span1") - buffer).alias("_s"), (F.col("span2") + buffer).alias("_e")).distinct()
    seen = fragments.select(F.col("contig").alias("_contig"), "inner1", "inner2").distinct()
    pairs = overlap_join(own, seen, [("contig", "_contig")], ("_s", "_e"), ("inner1", "inner2"), width)
    inside = "inner1 <= _s and inner2 >= _e" if enclose else "inner1 between span1 and span2 or inner2 between span1 and span2"
    return pairs.where(inside).groupBy("contig", "span1", "span2").agg(F.count("*").cast("int").alias("flanking"))


def with_support(events: DataFrame, support: DataFrame) -> DataFrame:
    """Events with spanning and flanking of their (contig, sorted contig breaks), 0 where there is none."""
    s = support.select(F.col("contig").alias("_c"), F.least("span1", "span2").alias("_s1"), F.greatest("span1", "span2").alias("_s2"), "spanning", "flanking")
    match = (F.col("query") == F.col("_c")) & (F.least("cb1", "cb2") == F.col("_s1")) & (F.greatest("cb1", "cb2") == F.col("_s2"))
    rows = events.join(s, match, "left").drop("_c", "_s1", "_s2")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("spanning", "flanking")})


def variant_support(variants: DataFrame, adjacencies: DataFrame, least: int = 2) -> DataFrame:
    """Variants (variant_id, adj_ids) all of whose adjacencies have at least ``least`` spanning reads, with the smallest support."""
    parts = variants.select("variant_id", F.explode("adj_ids").alias("adj_id")).join(adjacencies.select("adj_id", "spanning", "flanking"), "adj_id", "left")
    worst = lambda c: F.min(F.coalesce(c, F.lit(0))).alias(c)
    return parts.groupBy("variant_id").agg(worst("spanning"), worst("flanking")).where(F.col("spanning") >= least)


def somatic(tumour: DataFrame, normal: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the tumour with somatic true where the normal lacks their key, false (germline) where it has it."""
    marked = normal.select(*key).distinct().withColumn("_germline", F.lit(True))
    return tumour.join(marked, key, "left").withColumn("somatic", F.col("_germline").isNull()).drop("_germline")


def tiled(spans: DataFrame, reads: DataFrame, width: int = 500) -> DataFrame:
    """(contig, span1, span2, tiled): whether reads that overlap a span leave no gap between span1 and span2."""
    seen = reads.where("whole").withColumnRenamed("contig", "_contig")
    pairs = overlap_join(spans.select("contig", "span1", "span2").distinct(), seen, [("contig", "_contig")], ("span1", "span2"), ("rstart", "rend"), width)
    own = Window.partitionBy("contig", "span1", "span2").orderBy("rstart", "rend").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("rend").over(own), F.col("span1") - 1)
    rows = pairs.withColumn("_gap", (F.col("rstart") > reached + 1) & (reached < F.col("span2")))
    return rows.groupBy("contig", "span1", "span2").agg((~F.bool_or("_gap") & (F.max("rend") >= F.col("span2")) & (F.min("rstart") <= F.col("span1"))).alias("tiled"))


def pileup(sites: DataFrame, reads: DataFrame, width: int = 500) -> DataFrame:
    """(chrom, pos, base, n): bases of reads (chrom, blocks, seq) at sites (chrom, pos); deleted and skipped bases do not count."""
    parts = reads.select(F.col("chrom").alias("_c"), "seq", F.explode("blocks").alias("b")).select("_c", "seq", F.col("b.ts").alias("_s"), F.col("b.te").alias("_e"), F.col("b.qs").alias("_q"))
    own = sites.select("chrom", "pos").distinct().withColumn("_p", F.col("pos"))
    hits = overlap_join(own, parts, [("chrom", "_c")], ("pos", "_p"), ("_s", "_e"), width)
    base = F.upper(F.substr(F.col("seq"), (F.col("_q") + F.col("pos") - F.col("_s")).cast("int"), F.lit(1)))
    return hits.groupBy("chrom", "pos", base.alias("base")).agg(F.count("*").alias("n"))


def alternative_base(counts: DataFrame, reference: DataFrame, share: float = 0.25) -> DataFrame:
    """The commonest base at a site that is not the reference's, where it makes up more than ``share`` of all reads there."""
    total = F.sum("n").over(Window.partitionBy("chrom", "pos"))
    rows = counts.withColumn("coverage", total).join(reference.select("chrom", "pos", F.upper("ref").alias("ref")), ["chrom", "pos"]).where("base <> ref")
    nth = F.row_number().over(Window.partitionBy("chrom", "pos").orderBy(F.desc("n"), "base"))
    return rows.withColumn("_n", nth).where((F.col("_n") == 1) & (F.col("n") > F.col("coverage") * share)).drop("_n")
