"""VCF records as text columns, and the writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import reverse_complement

# The INFO keys in their order, with type, number and description.
INFO = (
    ("SVTYPE", "String", "1", "Type of structural variant"), ("EVENTTYPE", "String", "1", "Type of event where breakends are given"), ("PARID", "String", "1", "Partner breakend"),
    ("MATEID", "String", ".", "Mate breakends"), ("END", "Integer", "1", "End of the variant"), ("SVLEN", "Integer", ".", "Length difference of the alleles"),
    ("CIPOS", "Integer", "2", "Confidence interval around POS"), ("HOMLEN", "Integer", ".", "Length of microhomology"), ("HOMSEQ", "String", ".", "Sequence of microhomology"),
    ("BKPTID", "String", ".", "Assembled contigs"), ("EVENT", "String", "1", "Event of a breakend"), ("SPANNING_READS", "Integer", "1", "Reads that span the break"),
    ("FLANKING_PAIRS", "Integer", "1", "Read pairs around the break"), ("SOMATIC", "Flag", "0", "Somatic"), ("REPEAT_SEQ", "String", "1", "Repeated unit"),
    ("REPEAT_NUM", "Integer", "1", "Copies gained or lost"), ("REPEAT_NUM_CHANGE", "String", "1", "Copies before and after"),
)


def info(values: dict[str, Column]) -> Column:
    """key=value in the fixed order; null values are left out, flags that are true come bare, unknown keys are dropped."""
    parts = [F.when(values[k], k) if kind == "Flag" else F.concat(F.lit(f"{k}="), values[k].cast("string")) for k, kind, *_ in INFO if k in values]
    return F.concat_ws(";", *parts)


def bare(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^[chr]+", "")


def breakends(events: DataFrame, most_novel: int = 50) -> DataFrame:
    """Two records for each adjacency: adj_id, chrom1, break1, orient1, chrom2, break2, orient2, ref1, ref2, novel_seq, strand1, strand2, homol_seq,
    overlaps (the contig spans do), contigs, spanning, flanking. With homology the first place moves left by its length, the other's right.
    Where contig, cb1 and cb2 (of the first contig) are there, novel sequences of more than ``most_novel`` bases are not spelled out: the mates are the contig's bases
    next to the breaks."""
    c = F.col
    long = F.coalesce(F.length("novel_seq") > most_novel, F.lit(False)) if {"contig", "cb1", "cb2"} <= set(events.columns) else F.lit(False)
    n = F.when(c("overlaps"), F.length("homol_seq")).otherwise(0)
    n = F.coalesce(n, F.lit(0))
    ins = lambda s: F.coalesce(F.when(long, "").when(c(s) == "+", c("novel_seq")).otherwise(reverse_complement(c("novel_seq"))), F.lit(""))
    place1, place2 = F.concat(bare(c("chrom1")), F.lit(":"), c("break1")), F.concat(bare(c("chrom2")), F.lit(":"), c("break2") + n)
    if {"contig", "cb1", "cb2"} <= set(events.columns):
        inside = lambda at: F.concat(F.lit("<"), c("contig"), F.lit(">:"), at)
        place1, place2 = F.when(long, inside(c("cb2") - 1)).otherwise(place1), F.when(long, inside(c("cb1") + 1)).otherwise(place2)
    box = lambda mark, place: F.concat(F.lit(mark), place, F.lit(mark))
    a_first = lambda mark: F.concat(c("ref1"), ins("strand1"), box(mark, place2))
    a_last = lambda mark: F.concat(box(mark, place2), ins("strand1"), c("ref1"))
    b_first = lambda mark: F.concat(c("ref2"), ins("strand2"), box(mark, place1))
    b_last = lambda mark: F.concat(box(mark, place1), ins("strand2"), c("ref2"))
    o = F.concat("orient1", "orient2")
    alt1 = F.when(o == "LL", a_first("]")).when(o == "LR", a_first("[")).when(o == "RL", a_last("]")).otherwise(a_last("["))
    alt2 = F.when(o == "LL", b_first("]")).when(o == "LR", b_last("]")).when(o == "RL", b_first("[")).otherwise(b_last("["))
    common = {"SVTYPE": F.lit("BND"), "EVENTTYPE": F.upper("rearrangement"), "CIPOS": F.when(n > 0, F.concat(F.lit("0,"), n)), "HOMLEN": F.length("homol_seq"), "HOMSEQ": F.upper("homol_seq"), "BKPTID": c("contigs"), "SPANNING_READS": c("spanning"), "FLANKING_PAIRS": c("flanking")}
    if "size" in events.columns:
        common["SVLEN"] = c("size")
    for k, col in (("EVENT", "event_name"), ("SOMATIC", "somatic")):
        if col in events.columns:
            common[k] = c(col)
    ida, idb = F.concat(c("adj_id").cast("string"), F.lit("a")), F.concat(c("adj_id").cast("string"), F.lit("b"))
    partner = lambda end: {"PARID": F.concat(c("partner_id").cast("string"), F.lit(end))} if "partner_id" in events.columns else {}
    one = F.struct(bare(c("chrom1")).alias("chrom"), (c("break1") - n).alias("pos"), ida.alias("id"), c("ref1").alias("ref"), alt1.alias("alt"), info(common | {"MATEID": idb} | partner("a")).alias("info"))
    two = F.struct(bare(c("chrom2")).alias("chrom"), c("break2").alias("pos"), idb.alias("id"), c("ref2").alias("ref"), alt2.alias("alt"), info(common | {"MATEID": ida} | partner("b")).alias("info"))
    return events.select(F.explode(F.array(one, two)).alias("r")).select("r.*")


def symbolic(events: DataFrame) -> DataFrame:
    """One record for each deletion, duplication, inversion or insertion: adj_id, rearrangement, chrom1, break1, ref1, size, homol_seq, overlaps,
    contigs, spanning, flanking, repeat_seq, repeat_num, repeat_change. A column cipos goes before the interval that the homology gives."""
    c = F.col
    kind = F.upper("rearrangement")
    alt = F.when(kind == "DUP", "<DUP:TANDEM>").otherwise(F.concat(F.lit("<"), kind, F.lit(">")))
    end = F.when(kind == "INS", c("break1")).otherwise(c("break1") + c("size"))
    dup = lambda name: F.when(kind == "DUP", c(name))
    values = {
        "SVTYPE": kind, "END": end, "SVLEN": F.when(kind == "DEL", -c("size")).otherwise(c("size")), "CIPOS": F.when(c("overlaps") & (F.length("homol_seq") > 0), F.concat(F.lit("0,"), F.length("homol_seq"))),
        "HOMLEN": F.length("homol_seq"), "HOMSEQ": F.upper("homol_seq"), "BKPTID": c("contigs"), "SPANNING_READS": c("spanning"), "FLANKING_PAIRS": c("flanking"),
        "REPEAT_SEQ": dup("repeat_seq"), "REPEAT_NUM": dup("repeat_num"), "REPEAT_NUM_CHANGE": dup("repeat_change"),
    }
    if "cipos" in events.columns:
        values["CIPOS"] = F.coalesce(c("cipos"), values["CIPOS"])
    if "somatic" in events.columns:
        values["SOMATIC"] = c("somatic")
    ident = c("variant_id") if "variant_id" in events.columns else c("adj_id").cast("string")
    return events.select(bare(c("chrom1")).alias("chrom"), c("break1").alias("pos"), ident.alias("id"), c("ref1").alias("ref"), alt.alias("alt"), info(values).alias("info"))


def indels(events: DataFrame) -> DataFrame:
    """Records with the alleles spelled out: deletions from ref_seq (the base before and the deleted ones), insertions after ref1."""
    c = F.col
    deletion = c("rearrangement") == "del"
    values = {"BKPTID": c("contigs"), "SPANNING_READS": c("spanning")} | {k: F.when(deletion, c(v)) for k, v in (("REPEAT_SEQ", "repeat_seq"), ("REPEAT_NUM", "repeat_num"), ("REPEAT_NUM_CHANGE", "repeat_change"))}
    ref = F.upper(F.when(deletion, c("ref_seq")).otherwise(c("ref1")))
    alt = F.upper(F.when(deletion, F.left(c("ref_seq"), F.lit(1))).otherwise(F.concat("ref1", "novel_seq")))
    return events.select(bare(c("chrom1")).alias("chrom"), c("break1").alias("pos"), c("adj_id").cast("string").alias("id"), ref.alias("ref"), alt.alias("alt"), info(values).alias("info"))


def header(source: str, reference: str | None = None, assembly: str | None = None, date: str | None = None) -> list[str]:
    out = ["##fileformat=VCFv4.2", *([f"##fileDate={date}"] if date else []), f"##source={source}", *([f"##reference={reference}"] if reference else []), *([f"##assembly={assembly}"] if assembly else [])]
    out += [f'##INFO=<ID={k},Number={n},Type={t},Description="{d}">' for k, t, n, d in INFO]
    out += [f'##ALT=<ID={k},Description="{d}">' for k, d in (("DEL", "Deletion"), ("INS", "Insertion"), ("INV", "Inversion"), ("DUP:TANDEM", "Tandem duplication"))]
    return [*out, "#" + "\t".join(("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"))]


def write(records: DataFrame, path: str, head: list[str]) -> None:
    """Writes parts in the order of (chrom, pos) as text, the header in a part of its own before them."""
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", F.lit("."), F.lit("."), "info")
    ordered = records.select("chrom", F.col("pos").cast("string").alias("_pos"), line.alias("value")).repartitionByRange("chrom", "_pos").sortWithinPartitions("chrom", "_pos").select("value")
    spark = records.sparkSession
    first = spark.range(1, numPartitions=1).select(F.explode(F.array(*[F.lit(h) for h in head])).alias("value"))
    first.union(ordered).write.text(path)


def variant_records(variants: DataFrame, events: DataFrame, threshold: int = 100) -> DataFrame:
    """Records of variants (variant_id, event, chrom, pos, adj_ids) from the columns of their adjacencies that ``breakends``, ``symbolic`` and ``indels`` read.

    Two adjacencies that make an inversion or a large insertion are one symbolic record with the contigs of both and the smaller
    support, the interval between the breaks at an insertion's target (pos and, where variants have it, pos2) and the insertion's size; two reciprocal translocations are four breakends that name each other. Any other adjacency is a record of its own:
    breakends for a translocation, spelled-out alleles for insertions and deletions of up to ``threshold`` bases whose sequence is there, else symbolic.
    """
    for c in ("pos2", "insertion_size"):
        variants = variants if c in variants.columns else variants.withColumn(c, F.lit(None).cast("bigint"))
    each = variants.select("pos2", "insertion_size", "variant_id", "event", F.col("chrom").alias("_chrom"), F.col("pos").alias("_pos"), "adj_ids", F.posexplode("adj_ids").alias("_nth", "adj_id"))
    rows = each.join(events, "adj_id").withColumn("_pair", F.size("adj_ids") == 2)
    one = rows.where(F.col("_pair") & F.col("event").isin("INV", "INS"))
    at = lambda n: (F.col(f"chrom{n}") == F.col("_chrom")) & (F.col(f"break{n}") == F.col("_pos"))
    base = F.when(at(1), F.col("ref1")).when(at(2), F.col("ref2"))
    both = one.groupBy("variant_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("contigs", ","))))), ",").alias("contigs"), F.min("spanning").alias("spanning"), F.min("flanking").alias("flanking"), F.max(base).alias("_base"))
    one = one.where("_nth = 0").drop("contigs", "spanning", "flanking").join(both, "variant_id")
    inserted, apart = F.col("event") == "INS", F.col("pos2") - F.col("_pos")
    between = F.when(apart > 0, F.concat(F.lit("0,"), apart)).when(apart < 0, F.concat(apart, F.lit(",0")))
    one = one.withColumns({
        "ref1": F.when(inserted, F.coalesce("_base", "ref1")).otherwise(F.col("ref1")), "chrom1": F.when(inserted, F.col("_chrom")).otherwise(F.col("chrom1")), "break1": F.when(inserted, F.col("_pos")).otherwise(F.col("break1")),
        "rearrangement": F.lower("event"), "size": F.when(inserted, F.coalesce("insertion_size", "size")).otherwise(F.col("size")),
        "cipos": F.when(inserted, between).when(F.length("homol_seq") > 0, F.concat(F.lit("0,"), F.length("homol_seq"))),
    })
    rest = rows.where(~F.col("_pair") | ~F.col("event").isin("INV", "INS"))
    linked = F.col("_pair") & (F.col("event") == "TRL")
    ends = rest.where("rearrangement = 'trl'").withColumns({"partner_id": F.when(linked, F.element_at("adj_ids", F.lit(2) - F.col("_nth"))), "event_name": F.when(linked, F.concat("event", "variant_id"))})
    short = F.col("rearrangement").isin("ins", "del") & (F.col("size") <= threshold) & F.when(F.col("rearrangement") == "del", F.col("ref_seq").isNotNull()).otherwise(F.col("novel_seq").isNotNull())
    short = F.coalesce(short, F.lit(False))
    alone = rest.where("rearrangement <> 'trl'")
    by_adjacency = alone.where(~short).withColumn("variant_id", F.col("adj_id").cast("string"))
    return breakends(ends).unionByName(symbolic(one)).unionByName(symbolic(by_adjacency)).unionByName(indels(alone.where(short)))
