"""Alignment segments of contigs: which alignments count, how segments chain, and what a pair of segments says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions.coords import chrom_key, is_alternative
from ..lineage import cut


def primary_split(alignments: DataFrame) -> DataFrame:
    """Adds is_primary: clipped and not flagged secondary. Where a contig with several primaries has one on an alternative
    target, those become secondary and all secondaries on other targets become primary."""
    clipped = F.exists("cigar", lambda x: x["op"].isin("S", "H"))
    first = clipped & (F.col("flag").bitwiseAND(256) == 0)
    rows = alignments.withColumn("_first", first).withColumn("_alt", F.coalesce(is_alternative(F.col("target")), F.lit(False)))
    own = Window.partitionBy("query")
    swap = (F.count_if("_first").over(own) > 1) & (F.count_if(F.col("_first") & F.col("_alt")).over(own) > 0)
    return rows.withColumn("_swap", swap).withColumn("is_primary", F.when(F.col("_swap"), ~F.col("_alt")).otherwise(F.col("_first"))).drop("_first", "_alt", "_swap")


def chimera_candidates(segments: DataFrame, most: int = 3) -> DataFrame:
    """Segments of contigs with 2 to ``most`` primaries that are all valid and no secondary from end to end."""
    valid = C.is_valid(F.col("qstart"), F.col("qend"), F.col("tstart"), F.col("tend"))
    own = Window.partitionBy("query")
    whole = ~F.col("is_primary") & (F.col("qstart") == 1) & (F.col("qend") == F.col("query_len"))
    n, bad, ends = F.count_if("is_primary").over(own), F.count_if(F.col("is_primary") & ~valid).over(own), F.count_if(whole).over(own)
    rows = segments.withColumns({"_n": n, "_bad": bad, "_ends": ends}).where(F.col("_n").between(2, most) & (F.col("_bad") == 0) & (F.col("_ends") == 0))
    return rows.where(F.col("is_primary") | valid).drop("_n", "_bad", "_ends")


def unique_alignments(alignments: DataFrame, least: float = 0.95, most_edits: float = 0.1) -> DataFrame:
    """Alignments that are the only one of their contig, map there alone (mapq above 0), cover at least ``least`` of the contig
    and have at most ``most_edits`` edits, indels not counted, for each base."""
    mapped = alignments.where((F.col("flag").bitwiseAND(4) == 0) & (F.col("flag").bitwiseAND(256) == 0))
    rows = mapped.withColumn("_n", F.count("*").over(Window.partitionBy("query"))).where("_n = 1 and mapq > 0")
    size = C.query_length(F.col("cigar"))
    edits = C.effective_edits(F.col("nm"), F.col("cigar"))
    kept = (C.matched_length(F.col("cigar")) >= least * F.length("seq")) & (edits.isNull() | (edits <= most_edits * size))
    return rows.where(kept).drop("_n")


def to_segments(alignments: DataFrame) -> DataFrame:
    """Blocks, spans and query length of alignments that have a flag, pos and cigar; strand from the flag unless given."""
    rows = alignments if "strand" in alignments.columns else alignments.withColumn("strand", F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+"))
    rows = rows.withColumn("blocks", C.blocks(F.col("cigar"), F.col("pos"), F.col("strand"))).withColumn("_s", C.span(F.col("blocks")))
    rows = rows.withColumn("query_len", C.query_length(F.col("cigar")))
    return rows.withColumns({c: F.col(f"_s.{c}") for c in ("tstart", "tend", "qstart", "qend")}).drop("_s")


def consecutive(segments: DataFrame) -> DataFrame:
    """Each segment with the next one of its contig, in the order of qstart: columns a and b, both structs."""
    own = Window.partitionBy("query").orderBy("qstart", "qend", "seg_id")
    row = F.struct(*[F.col(c) for c in segments.columns])
    return segments.select("query", row.alias("a"), F.lead(row).over(own).alias("b")).where("b is not null")


def classify(pairs: DataFrame, sort: bool = True, transcript: bool = False, most_inversion_overlap: int = 30_000) -> DataFrame:
    """What pairs of consecutive segments say.

    The break of the first is where it ends in the direction of the contig, that of the second where it begins; L marks a break at
    the right end of what is kept, R one at the left end. With ``sort`` the lower place comes first. The first rule that fits
    names the rearrangement: other targets trl; LL or RR inv; LR with touching breaks del where the contig spans overlap (breaks
    move to the other side of the overlap) else ins; LR in order del, else dup; RL with equal breaks ins, else dup. In transcripts RL
    is a dup only in order, else a del, and an inversion of segments that overlap by more than ``most_inversion_overlap`` on the target is
    none.
    """
    fa, fb = F.col("a.strand") == "+", F.col("b.strand") == "+"
    one = F.struct(F.col("a.target").alias("chrom"), F.when(fa, F.col("a.tend")).otherwise(F.col("a.tstart")).alias("pos"), F.when(fa, "L").otherwise("R").alias("orient"))
    two = F.struct(F.col("b.target").alias("chrom"), F.when(fb, F.col("b.tstart")).otherwise(F.col("b.tend")).alias("pos"), F.when(fb, "R").otherwise("L").alias("orient"))
    rows = pairs.select("query", "a", "b", one.alias("x"), two.alias("y"), F.col("a.qend").alias("cb1"), F.col("b.qstart").alias("cb2"))
    key = lambda c: F.struct(chrom_key(F.col(f"{c}.chrom")), F.col(f"{c}.pos"))
    swap = (key("y") < key("x")) if sort else F.lit(False)
    rows = rows.withColumn("swapped", swap).withColumn("p", F.when(F.col("swapped"), F.col("y")).otherwise(F.col("x"))).withColumn("q", F.when(F.col("swapped"), F.col("x")).otherwise(F.col("y")))
    b0, b1, o = F.col("p.pos"), F.col("q.pos"), F.concat(F.col("p.orient"), F.col("q.orient"))
    touching, over = (b0 + 1 == b1) | (b0 == b1), F.col("cb1") >= F.col("cb2")
    back = F.when(b0 < b1, "dup").otherwise("del") if transcript else F.lit("dup")
    kind = F.when(F.col("p.chrom") != F.col("q.chrom"), "trl").when(o.isin("LL", "RR"), "inv").when((o == "LR") & touching & over, "del").when((o == "LR") & touching, "ins")
    kind = kind.when((o == "LR") & (b0 < b1), "del").when((o == "LR") & (b0 > b1), "dup").when((o == "RL") & (b0 == b1), "ins").when(o == "RL", back)
    moved = (F.col("p.chrom") == F.col("q.chrom")) & (o == "LR") & touching & over
    rows = rows.withColumn("rearrangement", kind)
    if transcript:
        shared = F.least("a.tend", "b.tend") - F.greatest("a.tstart", "b.tstart") + 1
        rows = rows.where((F.col("rearrangement") != "inv") | (shared <= most_inversion_overlap))
    homologous = over & ~moved
    return rows.select(
        "query", F.col("a.seg_id").alias("seg1"), F.col("b.seg_id").alias("seg2"), "rearrangement",
        F.col("p.chrom").alias("chrom1"), F.when(moved, b1 + 1).otherwise(b0).alias("break1"), F.col("p.orient").alias("orient1"),
        F.col("q.chrom").alias("chrom2"), F.when(moved, b0 + F.col("cb1") - F.col("cb2") + 1).otherwise(b1).alias("break2"), F.col("q.orient").alias("orient2"),
        "cb1", "cb2", "swapped", F.col("a.strand").alias("strand1"), F.col("b.strand").alias("strand2"),
        F.when(homologous, F.col("cb2")).alias("homol1"), F.when(homologous, F.col("cb1")).alias("homol2"),
    )


def junction_sequences(events: DataFrame, sequences: DataFrame) -> DataFrame:
    """Adds homol_seq (what both segments cover) and novel_seq (what neither covers, on the first segment's strand)."""
    from ..functions.sequences import reverse_complement

    seqs = sequences.select(F.col("name").alias("_name"), F.col("seq").alias("_seq"))
    rows = events.join(seqs, F.col("query") == F.col("_name"))
    at = lambda s, e: F.substr(F.col("_seq"), s.cast("int"), (e - s + 1).cast("int"))
    cb1, cb2 = F.col("cb1"), F.col("cb2")
    gap = at(cb1 + 1, cb2 - 1)
    novel = F.when(cb2 - cb1 > 1, F.when(F.col("strand1") == "-", reverse_complement(gap)).otherwise(gap))
    return rows.withColumn("homol_seq", F.when(F.col("homol1").isNotNull(), at(F.col("homol1"), F.col("homol2")))).withColumn("novel_seq", novel).drop("_name", "_seq")


def edges(segments: DataFrame, most_overlap: float = 0.2, most_gap: float = 0.2) -> DataFrame:
    """Pairs of segments of one contig of which the second can follow the first: it starts and ends later, and overlap and gap
    are below these shares of both."""
    a = segments.select("query", F.col("seg_id").alias("i"), F.col("qstart").alias("s1"), F.col("qend").alias("e1"))
    b = segments.select(F.col("query").alias("_q"), F.col("seg_id").alias("j"), F.col("qstart").alias("s2"), F.col("qend").alias("e2"))
    near, over, gap = _follows(*(F.col(c) for c in ("s1", "e1", "s2", "e2")), most_overlap, most_gap)
    return a.join(b, (F.col("query") == F.col("_q")) & near).select("query", "i", "j", over.alias("overlap"), gap.alias("gap"))


def _follows(s1: Column, e1: Column, s2: Column, e2: Column, most_overlap: float = 0.2, most_gap: float = 0.2) -> tuple[Column, Column, Column]:
    """Whether a segment (s2, e2) can follow another one (s1, e1), and their overlap and gap."""
    shorter = F.least(e1 - s1 + 1, e2 - s2 + 1)
    over, gap = F.greatest(F.lit(0), e1 - s2 + 1), F.greatest(F.lit(0), s2 - e1 - 1)
    return (s2 > s1) & (e2 > e1) & (over / shorter < most_overlap) & (gap / shorter < most_gap), over, gap


def _chains_in_rows(segments: DataFrame, node: list[str]) -> DataFrame:
    """The chains (query, query_len, path, done) of contigs of few segments: each contig is a row, whose segments are added in the order of their
    starts to all chains that they can follow."""
    own = lambda x: F.struct(*[x[c].alias(c) for c in node])
    chain = lambda x: F.struct(F.array(own(x)).alias("path"), x["query_len"].alias("query_len"), x["_ends"].alias("done"))
    all_of = F.sort_array(F.collect_list(F.struct("qstart", "qend", "seg_id", "target", "query_len", "_starts", "_ends")))
    rows = segments.groupBy("query").agg(all_of.alias("_all"))
    none = F.filter(F.array(chain(F.col("_all")[0])), lambda c: F.lit(False))

    def add(found: Column, x: Column) -> Column:
        last = lambda c: F.element_at(c["path"], -1)
        before = F.filter(found, lambda c: _follows(last(c)["qstart"], last(c)["qend"], x["qstart"], x["qend"])[0])
        longer = F.transform(before, lambda c: F.struct(F.array_append(c["path"], own(x)).alias("path"), c["query_len"].alias("query_len"), x["_ends"].alias("done")))
        return F.concat(found, longer, F.filter(F.array(chain(x)), lambda c: x["_starts"]))

    found = F.filter(F.aggregate("_all", none, add), lambda c: c["done"])
    return rows.select("query", F.explode(found).alias("_c")).select("query", "_c.query_len", "_c.path", "_c.done")


def _chains_in_rounds(segments: DataFrame, node: list[str]) -> DataFrame:
    """The same for contigs of any number of segments: chains grow by a segment in each round, by joins, until none does; as starts ascend, that
    ends after as many rounds as a contig has segments at most."""
    links = cut(edges(segments).select("i", "j"))
    step = segments.where("_starts").select("query", "query_len", F.array(F.struct(*node)).alias("path"), F.col("seg_id").alias("at"), F.col("_ends").alias("done"))
    found = step
    nodes = segments.select(F.col("seg_id").alias("j"), F.struct(*node).alias("node"), F.col("_ends").alias("done"))
    while True:
        step = cut(step.drop("done").join(links, F.col("at") == F.col("i")).join(nodes, "j").select("query", "query_len", F.array_append("path", F.col("node")).alias("path"), F.col("j").alias("at"), "done"))
        if step.isEmpty():
            break
        found = found.union(step)
    return found.where("done").select("query", "query_len", "path", "done")


def paths(segments: DataFrame, from_edge: float = 0.02, least: float | None = 0.95, in_row: int = 24) -> DataFrame:
    """All chains of segments from one end of a contig to the other: (query, path, targets, covered, overlapped, n), numbered in
    the order of their segments. A single segment can be a path of its own. Contigs of up to ``in_row`` segments are worked out in a row each, with
    some thousand chains at most; those of more segments grow by rounds of joins, which give the same chains."""
    edge = F.greatest(F.lit(1), F.floor(F.col("query_len") * from_edge))
    node = ["seg_id", "qstart", "qend", "target"]
    rows = segments.select("query", "query_len", *node, (F.col("qstart") <= edge).alias("_starts"), (F.col("qend") >= F.col("query_len") - edge + 1).alias("_ends"))
    rows = rows.withColumn("_few", F.col("query").isNotNull() & (F.count("*").over(Window.partitionBy("query")) <= in_row))
    found = _chains_in_rows(rows.where("_few"), node)
    many = cut(rows.where("not _few"))
    if not many.isEmpty():
        found = found.union(_chains_in_rounds(many, node))
    over = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), F.lit(0).cast("bigint"), lambda a, k: a + F.coalesce(F.greatest(F.lit(0), F.get("path", k - 1)["qend"] - F.get("path", k)["qstart"] + 1), F.lit(0)))
    total = F.aggregate("path", F.lit(0).cast("bigint"), lambda a, p: a + p["qend"] - p["qstart"] + 1)
    ids = F.transform("path", lambda p: p["seg_id"])
    out = found.select("query", ids.alias("_ids"), F.array_sort(F.array_distinct(F.transform("path", lambda p: p["target"]))).alias("targets"), over.alias("overlapped"), (total - over).alias("covered"),
                       ((F.element_at("path", -1)["qend"] - F.get("path", F.lit(0))["qstart"] + 1) / F.col("query_len")).alias("share")).withColumnRenamed("_ids", "path")
    if least is not None:
        out = out.where(F.col("share") >= least)
    nth = F.row_number().over(Window.partitionBy("query").orderBy("path"))
    return out.withColumn("n", nth)


def best_path(found: DataFrame) -> DataFrame:
    """One path for each contig: scanning in order, a path replaces the best so far if it covers more, overlaps less or has fewer
    targets. The order matters, as these do not rank paths."""
    one = F.struct("n", "path", "targets", "covered", "overlapped")
    better = lambda a, x: (x["covered"] > a["covered"]) | (x["overlapped"] < a["overlapped"]) | (F.size(x["targets"]) < F.size(a["targets"]))
    rows = found.groupBy("query").agg(F.sort_array(F.collect_list(one)).alias("all"))
    pick = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.get("all", F.lit(0)), lambda a, x: F.when(better(a, x), x).otherwise(a))
    return rows.select("query", pick.alias("best")).select("query", "best.*")


def gapped_indels(segments: DataFrame, sequences: DataFrame, target_sequence: Column | None = None, insertions_stay: bool = False, least_size: int = 0, least_flank: int = 0) -> DataFrame:
    """Deletions, indels, insertions and duplications from the gaps between blocks of single alignments.

    Gaps of the target are deletions where the contig has none, else indels; gaps of the contig alone are insertions. Where the
    inserted sequence repeats one base or a unit of 2 to 4, and flanking copies of the unit are there, it is a duplication with
    breaks on the side of the copies, unless ``insertions_stay``; contig breaks move to the outer ends of the copies.
    Insertions and deletions of less than ``least_size`` bases go, and those with less than ``least_flank`` bases of the contig on a side.
    ``target_sequence`` gives a deleted sequence from (target, tstart, tend) where it is known; deletions count copies too then.
    """
    from ..functions.sequences import copies_after, copies_before, repeat_unit, reverse_complement

    seqs = sequences.select(F.col("name").alias("_name"), F.col("seq").alias("_seq"))
    rows = segments.join(seqs, F.col("query") == F.col("_name")).select("seg_id", "query", "target", "strand", "_seq", F.explode(C.gaps(F.col("blocks"))).alias("g"))
    rows = rows.where("g.tgap > 0 or g.qgap > 0")
    forward = F.col("strand") == "+"
    rows = rows.select(
        "seg_id", "query", "target", "strand", "_seq", F.col("g.i").alias("gap"), F.col("g.before.te").alias("t1"), F.col("g.after.ts").alias("t2"), F.col("g.before.qe").alias("q1"), F.col("g.after.qs").alias("q2"), F.col("g.tgap").alias("tgap"), F.col("g.qgap").alias("qgap"),
    )
    low = F.least("q1", "q2")
    indel = (F.col("tgap") > 0) & (F.col("qgap") != 0)
    if least_size > 0:
        rows = rows.where(indel | (F.greatest("tgap", "qgap") >= least_size))
    if least_flank > 0:
        rows = rows.where(indel | ((low >= least_flank) & (F.length("_seq") - F.greatest("q1", "q2") + 1 >= least_flank)))
    inserted = F.substr(F.col("_seq"), (low + 1).cast("int"), F.col("qgap").cast("int"))
    removed = target_sequence if target_sequence is not None else F.lit(None).cast("string")
    removed = F.when(forward, removed).otherwise(reverse_complement(removed))
    changed = F.when(F.col("tgap") > 0, removed).otherwise(inserted)
    rows = rows.withColumn("changed", changed).withColumn("unit", repeat_unit(F.col("changed")))
    rows = rows.withColumn("before", F.coalesce(copies_before(F.col("_seq"), low, F.col("unit")), F.lit(0))).withColumn("after", F.coalesce(copies_after(F.col("_seq"), F.greatest("q1", "q2"), F.col("unit"), to_end=False), F.lit(0)))
    copied = (F.col("before") > 0) | (F.col("after") > 0)
    n = F.length("changed")
    insertion = F.col("tgap") <= 0
    dup = insertion & copied & F.lit(not insertions_stay)
    kind = F.when(~insertion, F.when(F.col("qgap") == 0, "del").otherwise("indel")).otherwise(F.when(dup, "dup").otherwise("ins"))
    lower = (F.col("before") > 0) == forward  # the copies lie below the break
    b1 = F.when(dup & lower, F.col("t1") - n).otherwise(F.col("t1"))
    b2 = F.when(~insertion, F.col("t2")).when(dup, F.when(lower, F.col("t1") + 1).otherwise(F.col("t1") + n + 1)).otherwise(F.col("t1"))
    times = F.when(F.col("unit").isNotNull(), (n / F.length("unit")).cast("int"))
    flank, wide = F.col("before") + F.col("after"), F.coalesce(F.length("unit"), F.lit(0))
    both = F.when(insertion, F.concat_ws(">", flank, flank + times)).otherwise(F.concat_ws(">", flank + times, flank))
    shown = copied & (dup | ~insertion)
    own = lambda c: F.when(forward, c).otherwise(reverse_complement(c))
    return rows.select(
        "seg_id", "query", "gap", "target", "strand", kind.alias("rearrangement"), b1.alias("break1"), b2.alias("break2"), (F.col("q1") - wide * F.col("before")).alias("cb1"), (F.col("q2") + wide * F.col("after")).alias("cb2"),
        F.when(insertion, own(F.col("changed"))).alias("novel_seq"), F.when(shown, own(F.upper("unit"))).alias("repeat_seq"), F.when(shown, times).alias("repeat_num"), F.when(shown, both).alias("repeat_change"),
    )
