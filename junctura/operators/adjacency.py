"""Adjacencies: sizes, filters, merging of equal ones, and pairing into larger events."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import is_alternative
from ..functions.sequences import is_low_complexity
from ..lineage import cut
from .intervals import band_join

KEY = ["rearrangement", "chrom1", "break1", "orient1", "chrom2", "break2", "orient2"]


def size(rearrangement: Column, break1: Column, break2: Column, novel_seq: Column, gapped: Column, insertion_size: Column | None = None) -> Column:
    """Bases that an event covers; null for translocations."""
    known = insertion_size if insertion_size is not None else F.lit(None).cast("bigint")
    n = F.length(novel_seq).cast("bigint")
    return (
        F.when(gapped & rearrangement.isin("ins", "dup"), n).when(known.isNotNull(), known).when(rearrangement == "ins", n).when(rearrangement == "del", break2 - break1 - 1)
        .when(rearrangement != "trl", break2 - break1 + 1)
    )


def transcript_size(event: Column, same: Column, seq_break1: Column, seq_break2: Column, tx_break1: Column, tx_break2: Column, break1: Column, break2: Column, novel: Column, homol: Column) -> Column:
    """Bases that an event within one transcript covers; null between transcripts."""
    plus, minus = F.coalesce(F.length(novel), F.lit(0)), F.coalesce(F.length(homol), F.lit(0))
    dup = F.abs(tx_break2 - tx_break1) + 1 + plus - minus
    return F.when(same, F.when(event.isin("dup", "ITD", "PTD", "inv-dup", "repeat_expansion", "repeat_contraction"), dup).when(event == "ins", F.abs(seq_break2 - seq_break1) - 1 + plus - minus).when(event == "del", F.abs(break2 - break1) - 1 + minus))


def within_size(events: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Events of a size; those without one pass a lower bound and fail an upper one."""
    out = events
    if least is not None:
        out = out.where(F.col("size").isNull() | (F.col("size") >= least))
    if most is not None:
        out = out.where(F.col("size") <= most)
    return out


def same_event_twice(events: DataFrame) -> DataFrame:
    """Adds twice: whether a neighbour in the order of the contig is the same event at other contig breaks."""
    own = Window.partitionBy("query").orderBy("cb1", "cb2", *KEY)

    # Column by column: structs of them would be laid beside the columns in every row that is shuffled and sorted.
    def same(step: Callable[..., Column]) -> Column:
        equal = lambda names: reduce(Column.__and__, [step(c).over(own).eqNullSafe(F.col(c)) for c in names])
        return step(F.lit(True)).over(own).isNotNull() & equal(KEY) & ~equal(["cb1", "cb2"])

    return events.withColumn("twice", same(F.lag) | same(F.lead))


def sane(events: DataFrame, least_homology: int = 5) -> DataFrame:
    """Without events whose homology (from ``least_homology`` bases) is of low complexity, inversions of at most one base, and events that a
    contig has next to each other at two pairs of contig breaks, which say nothing; of equal rows the first stays."""
    low = F.coalesce((F.length("homol_seq") >= least_homology) & is_low_complexity(F.col("homol_seq")), F.lit(False))
    rows = same_event_twice(events).where(~low & ~F.col("twice") & ((F.col("rearrangement") != "inv") | (F.abs(F.col("break2") - F.col("break1")) > 1)))
    nth = F.row_number().over(Window.partitionBy("query", *KEY, "cb1", "cb2").orderBy("cb1"))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "twice")


def merge(events: DataFrame, order: str = "seq_no", extra: list[str] | None = None) -> DataFrame:
    """One row for each event, with its contigs and their breaks in the order of ``order``, and ids 1 to n in the order of the
    event's columns. The ids need a total order, so the merged events, far fewer than alignments, are numbered in one pass over ranges."""
    member = F.struct(F.col(order), F.col("query").alias("contig"), "cb1", "cb2", *(extra or []))
    rows = events.groupBy(*KEY).agg(F.sort_array(F.collect_list(member)).alias("members"), F.count("*").alias("n_contigs"))
    return number(rows, KEY, "adj_id")


def places(events: DataFrame) -> DataFrame:
    """The merged events with their ids, as in ``merge``, without their contigs: equal events meet as one row before they are shuffled."""
    return number(events.select(*KEY).distinct(), KEY, "adj_id")


def number(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Ids 1 to n in the order of the columns: rows are sorted in ranges, and each range is offset by the sizes of those before."""
    placed = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))  # cut, so that both uses see the same ranges
    own = Window.partitionBy("_part")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    nth = F.row_number().over(own.orderBy(*order))
    return placed.withColumn("_nth", nth).join(offsets, "_part").select((F.col("_before") + F.col("_nth")).alias(name), *rows.columns)


def pair_neighbours(events: DataFrame, by: list[str], order: list[str], pairable: Column, id_col: str = "adj_id", width: int = 1_000_000, most: int = 200_000) -> DataFrame:
    """Pairs of neighbours, taken greedily from the left: (partition columns, first, second).

    ``pairable`` is a condition over this row and the next, whose columns have the prefix ``next_``. Greedy pairing takes, in each
    run of pairable neighbours, the first, third and so on. Rows are ordered in bins of ``width`` bases of the first of ``order``, which are cut into places of
    about ``most`` rows where rows lie densely. What crosses bins, the next bin's first row and how far a run has come, is a row for each bin, so no window
    holds more than a chromosome's bins.
    """
    others = [c for c in events.columns if c not in by]
    this, key = F.struct(*others), F.struct(*order, id_col)
    rows = cut(events.withColumn("_wide", F.floor(F.col(order[0]) / width)))
    parts = max(1, -(-rows.count() // most))
    if parts > 1:  # ranges of the whole order: a bin's rows in one range are next to each other
        rows = cut(rows.repartitionByRange(parts, *by, *order, id_col).withColumn("_bin", F.struct("_wide", F.spark_partition_id().alias("part"))))
    else:
        rows = rows.withColumn("_bin", F.struct("_wide", F.lit(0).alias("part")))
    rows = rows.drop("_wide")
    bins = Window.partitionBy(*by).orderBy("_bin")
    following = rows.groupBy(*by, "_bin").agg(F.min_by(this, key).alias("_first")).select(*by, "_bin", F.lead("_first").over(bins).alias("_then"))
    own = Window.partitionBy(*by, "_bin").orderBy(*order, id_col)
    rows = rows.join(following, [*by, "_bin"]).withColumn("_next", F.coalesce(F.lead(this).over(own), F.col("_then")))
    rows = rows.withColumns({f"next_{c}": F.col(f"_next.{c}") for c in others}).withColumn("_flag", F.coalesce(pairable, F.lit(False))).withColumn("_nth", F.row_number().over(own))
    rows = rows.select(*by, "_bin", id_col, f"next_{id_col}", "_flag", "_nth", F.sum(F.when(F.col("_flag"), 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"))
    rows = cut(rows)
    # Of each bin: whether all its rows continue one run, and how many at its end do; then how many the run has that enters a bin.
    last = F.max(F.struct("_run", "_nth"))
    ends = rows.groupBy(*by, "_bin").agg(last["_run"].alias("_runs"), last["_nth"].alias("_n"), F.max(F.when(~F.col("_flag"), F.col("_nth"))).alias("_stop"))
    ends = ends.select(*by, "_bin", (F.col("_runs") > 0).alias("_cuts"), (F.col("_n") - F.coalesce("_stop", F.lit(0))).alias("_tail"))
    ends = ends.withColumn("_since", F.sum(F.col("_cuts").cast("int")).over(bins.rowsBetween(Window.unboundedPreceding, 0)))
    sofar = F.sum("_tail").over(Window.partitionBy(*by, "_since").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    enters = ends.withColumn("_sofar", sofar).select(*by, "_bin", F.coalesce(F.lag("_sofar").over(bins), F.lit(0)).alias("_enters"))
    rows = rows.where("_flag").withColumn("_in_run", F.row_number().over(Window.partitionBy(*by, "_bin", "_run").orderBy("_nth"))).join(enters, [*by, "_bin"])
    odd = (F.col("_in_run") + F.when(F.col("_run") == 0, F.col("_enters")).otherwise(0)) % 2 == 1
    return rows.where(odd).select(*by, F.col(id_col).alias("first"), F.col(f"next_{id_col}").alias("second"))


def _opposite(x: str, y: str, kinds: list[tuple[str, str]]) -> Column:
    tests = [(F.col(x) == a) & (F.col(y) == b) for a, b in kinds]
    return tests[0] | tests[1] if len(tests) == 2 else tests[0] | tests[1] | tests[2] | tests[3]


def pair_inversions(events: DataFrame, most: int = 25) -> DataFrame:
    """Pairs of inversion adjacencies, LL before RR, whose first breaks are at most ``most`` apart."""
    rows = events.where("rearrangement = 'inv'").select("adj_id", "chrom1", "break1", F.concat("orient1", "orient2").alias("o"))
    test = (F.col("next_break1") - F.col("break1") <= most) & _opposite("o", "next_o", [("LL", "RR"), ("RR", "LL")])
    found = pair_neighbours(rows, ["chrom1"], ["break1"], test)
    o = rows.select(F.col("adj_id").alias("first"), "o")
    return found.join(o, "first").select("chrom1", F.when(F.col("o") == "LL", F.col("first")).otherwise(F.col("second")).alias("adj1"), F.when(F.col("o") == "LL", F.col("second")).otherwise(F.col("first")).alias("adj2"))


def pair_translocations(events: DataFrame, most: int = 10_000) -> DataFrame:
    """Pairs of translocation adjacencies with complementary orientations, both of whose breaks are at most ``most`` apart.
    Neighbours are in the order of the first chromosome and break; doubtful ones are left out."""
    rows = events.where("rearrangement = 'trl' and not coalesce(dubious, false)").select("adj_id", "chrom1", "break1", "chrom2", "break2", F.concat("orient1", "orient2").alias("o"))
    near = (F.col("next_chrom2") == F.col("chrom2")) & (F.abs(F.col("next_break1") - F.col("break1")) <= most) & (F.abs(F.col("next_break2") - F.col("break2")) <= most)
    found = pair_neighbours(rows, ["chrom1"], ["break1"], near & _opposite("o", "next_o", [("LR", "RL"), ("RL", "LR"), ("LL", "RR"), ("RR", "LL")]))
    return found.select("chrom1", F.col("first").alias("adj1"), F.col("second").alias("adj2"))


def _take(each_once: bool, most: int, taking: int | None):
    """Plain loop over the candidates of a block of takers. A row with ``stop`` says that the taker ``i`` needs candidates beyond its first ``most``."""

    def run(rows):
        import numpy as np
        import pyarrow as pa

        value = {c: rows.column(c).to_numpy() for c in ("i", "x", "y", "n")}
        order = np.lexsort((value["n"], value["i"]))
        used, taker, kept, stop = {taking} - {None}, taking, [], None
        for at, i, x, y, n in zip(order.tolist(), *(value[c][order].tolist() for c in ("i", "x", "y", "n")), strict=True):
            if x in used and (each_once or taker != i):
                continue
            if n > most:
                stop = at
                break
            if y not in used:
                used.update((x, y))
                taker = i
                kept.append(at)
        out = rows.take(pa.array(kept + ([] if stop is None else [stop]), pa.int64())).drop_columns(["n"])
        return out.append_column("stop", pa.array([False] * len(kept) + ([] if stop is None else [True]), pa.bool_()))

    return run


def _in_turn(nodes: DataFrame, find: Callable[[DataFrame, DataFrame], DataFrame], each_once: bool, order: list[Column], later: bool = False, block: int = 50_000, most: int = 80) -> DataFrame:
    """Takes pairs (i, j) in order, each i with every free j, or each once: (i, j, x, y, and what else ``find`` gives).

    ``nodes``: id, own (a number, what a pair uses up), and what ``find`` reads; ``find(takers, free)`` gives the candidate pairs of some
    nodes; ``later`` says that it pairs no node with one of a smaller id. Ids take their turns in blocks: the candidates of a block among nodes that are still free are found by Spark, the first ``most``
    of each taker in ``order`` are kept, and one loop takes from them. It stops at a taker for which these are not enough, where the next block
    begins. So no list of all pairs is made, and a block has at most ``block * most`` rows (and one more of each taker); where blocks stop early, the next have fewer
    takers with more candidates each.
    """
    free, out, start, taking, size, room = cut(nodes), None, None, None, block, block * most
    while True:
        turn = free if start is None else free.where(F.col("id") >= start)
        last = turn.select("id").distinct().orderBy("id").limit(size).agg(F.max("id")).first()[0]
        if last is None:
            return out if out is not None else find(free, free).limit(0)
        pairs = find(F.broadcast(turn.where(F.col("id") <= last)), free)
        listed = room // size
        first = pairs.withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy("j", *order))).where(F.col("n") <= listed + 1)
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema if f.name != "n")
        got = cut(first.groupBy().applyInArrow(_take(each_once, listed, taking), f"{kept}, stop boolean"))
        said = got.agg(F.max(F.when(F.col("stop"), F.col("i"))), F.max(F.when(F.col("stop"), F.col("x"))), F.count("*"), F.max(F.when(~F.col("stop"), F.col("i")))).first()
        stop, owner, rows, latest = said
        taken = got.where("not stop").drop("stop")
        out = taken if out is None else out.union(taken)
        gone = taken.select(F.explode(F.array("x", "y")).alias("own")).distinct()
        gone = F.broadcast(gone) if rows <= 500_000 else gone
        rest = free.where(F.lit(True) if taking is None or stop == taking else F.col("own") != taking)
        # A taker that is to go on keeps its place.
        again = stop if not each_once and (stop == latest or stop == taking) else None
        if again is not None:
            gone = gone.where(F.col("own") != owner)
        rest = rest.join(gone, "own", "left_anti").select(*free.columns)
        start, taking = (last + 1, None) if stop is None else (stop, owner if again is not None else None)
        free = cut(rest.where(F.col("id") >= start) if later else rest)
        size = min(block, size * 2) if stop is None else max(1, size // 4)


def _first_come(candidates: DataFrame, each_once: bool, ends: tuple[str, str] = ("i", "j")) -> DataFrame:
    """Takes candidate pairs (i, j) in order, each i with every free j, or each once. What a pair uses up is its ``ends``, numbers."""
    x, y = ends
    known = cut(candidates)
    nodes = known.select(F.explode(F.array(*[F.struct(F.col(a).alias("id"), F.col(b).alias("own")) for a, b in (("i", x), ("j", y))])).alias("_e")).select("_e.*").distinct()

    def find(takers, free):
        side = lambda p, n: p.select(F.col("id").alias(n), F.col("own").alias({"i": "x", "j": "y"}[n]))
        return known.select("i", "j").join(side(takers, "i"), "i").join(side(free, "j"), "j").select("i", "j", "x", "y")

    return known.join(_in_turn(nodes, find, each_once, []).select("i", "j"), ["i", "j"]).select(*known.columns)


def insertions_between(events: DataFrame, first: bool = True, most: int = 500) -> DataFrame:
    """Pairs of adjacencies that together insert a piece of one chromosome into another: (adj1, adj2, chrom, pos1, pos2, insertion_size).

    On the target (the first break, or the second) they are at most ``most`` apart with other orientations; on the source their
    breaks are the outer ends of the two aligned spans and point at each other. ``span1_*``, ``span2_*`` are the spans of the aligned
    segments on the two sides. Earlier ids come first; one adjacency may take several partners, but none is taken twice.
    Outer ends that point at each other are a low one (R) of the first and a high one (L) of the second, so no adjacency is the first of one
    pair and the second of another: each second goes to the smallest id that it meets, with no order of turns to keep.
    """
    t, s = ("1", "2") if first else ("2", "1")
    names = {"id": "adj_id", "tc": f"chrom{t}", "tp": f"break{t}", "to": f"orient{t}", "sc": f"chrom{s}", "sp": f"break{s}", "so": f"orient{s}", "ss": f"span{s}_start", "se": f"span{s}_end"}
    nodes = cut(events.where("not coalesce(dubious, false)").select(*[F.col(c).cast("long" if n == "id" else events.schema[c].dataType).alias(n) for n, c in names.items()]))
    side = lambda p: nodes.select(*[F.col(c).alias(f"{p}_{c}") for c in names])
    firsts = side("a").where("a_so = 'R' and not coalesce(a_sp > least(a_ss, a_se), false)")
    seconds = side("b").where("b_so = 'L' and not coalesce(b_sp < greatest(b_ss, b_se), false)").withColumn("_to", F.when(F.col("b_to") == "L", "R").when(F.col("b_to") == "R", "L"))
    pairs = band_join(firsts, seconds, [("a_tc", "b_tc"), ("a_sc", "b_sc"), ("a_to", "_to")], "a_tp", "b_tp", most)
    low, high = F.least("a_ss", "a_se", "b_ss", "b_se"), F.greatest("a_ss", "a_se", "b_ss", "b_se")
    pairs = pairs.where((F.col("a_sp") == low) & (F.col("b_sp") == high) & (F.col("a_sp") < F.col("b_sp")))
    taken = pairs.groupBy("b_id", "b_tc", "b_tp", "b_sp").agg(F.min("a_id").alias("a_id"))  # minima by hash in the join's own task: pairs are neither sorted nor sent
    found = taken.join(firsts.select("a_id", "a_tp", "a_sp"), "a_id")
    return found.select(F.col("a_id").alias("adj1"), F.col("b_id").alias("adj2"), F.col("b_tc").alias("chrom"), F.col("a_tp").alias("pos1"), F.col("b_tp").alias("pos2"), (F.abs(F.col("a_sp") - F.col("b_sp")) + 1).alias("insertion_size"))


def imprecise_insertions(events: DataFrame, most: int = 50) -> DataFrame:
    """Pairs of adjacencies that meet within ``most`` bases at a target with other orientations, and whose sources either lie on other
    chromosomes, or on one, further apart and facing each other: (adj1, adj2, t1, t2, chrom, pos1, pos2, insertion_size), the target's breaks
    in order and the size null for sources on different chromosomes. Each ``contig``, the first one of an adjacency, is used once and never with
    itself, earlier ids first; without that column each adjacency is used once."""
    contig = F.col("contig") if "contig" in events.columns else F.col("adj_id")
    # The smallest id stands for a contig.
    rows = events.withColumn("_contig", contig)
    rows = rows.join(rows.groupBy("_contig").agg(F.min("adj_id").cast("long").alias("_own")), "_contig")
    sides = []
    for t, s in (("1", "2"), ("2", "1")):
        sides.append(rows.select(F.col("adj_id").cast("long").alias("id"), F.col("_own").alias("own"), F.lit(int(t)).alias("t"), F.col(f"chrom{t}").alias("tc"), F.col(f"break{t}").alias("tp"), F.col(f"orient{t}").alias("to"), F.col(f"chrom{s}").alias("sc"), F.col(f"break{s}").alias("sp"), F.col(f"orient{s}").alias("so"), F.col(f"span{t}_start").alias("ts")))
    both = sides[0].union(sides[1])

    def faces(x: str, y: str) -> Column:
        c = lambda p, n: F.col(f"{p}_{n}")
        source = ((c(x, "sp") < c(y, "sp")) & (c(x, "so") == "R") & (c(y, "so") == "L")) | ((c(x, "sp") > c(y, "sp")) & (c(x, "so") == "L") & (c(y, "so") == "R"))
        return (c(x, "ts") < c(y, "ts")) & (c(x, "to") == "L") & (c(y, "to") == "R") & source

    def find(takers, free):
        side = lambda rows, p: rows.select(*[F.col(c).alias(f"{p}_{c}") for c in both.columns])
        other = side(free, "b").withColumn("_to", F.when(F.col("b_to") == "L", "R").when(F.col("b_to") == "R", "L"))
        pairs = band_join(side(takers, "a"), other, [("a_tc", "b_tc"), ("a_to", "_to")], "a_tp", "b_tp", most).where("a_id < b_id and a_own <> b_own")
        same = (F.col("a_sc") == F.col("b_sc")) & (F.abs(F.col("a_sp") - F.col("b_sp")) > most) & (faces("a", "b") | faces("b", "a"))
        return pairs.where((F.col("a_sc") != F.col("b_sc")) | same).select(*[F.col(c).alias(n) for c, n in (("a_id", "i"), ("b_id", "j"), ("a_own", "x"), ("b_own", "y"), ("a_t", "t1"), ("b_t", "t2"))])

    # Of the two ways in which a pair may meet, the one of the later sides comes first and so is the one taken. The loop gets numbers alone; places are looked up for what it takes.
    both = cut(both)
    found = _in_turn(both, find, True, [F.desc("t1"), F.desc("t2")], later=True).select("i", "j", "t1", "t2")
    end = lambda i, t, p: both.select(F.col("id").alias(i), F.col("t").alias(t), *[F.col(c).alias(f"{p}_{c}") for c in ("tc", "tp", "sc", "sp")])
    found = found.join(end("i", "t1", "a"), ["i", "t1"]).join(end("j", "t2", "b"), ["j", "t2"])
    size = F.when(F.col("a_sc") == F.col("b_sc"), F.abs(F.col("a_sp") - F.col("b_sp")) + 1)
    return found.select(F.col("i").alias("adj1"), F.col("j").alias("adj2"), "t1", "t2", F.col("a_tc").alias("chrom"), F.least("a_tp", "b_tp").alias("pos1"), F.greatest("a_tp", "b_tp").alias("pos2"), size.alias("insertion_size"))


def sound_variants(variants: DataFrame, events: DataFrame, most_homology: int = 25) -> DataFrame:
    """Variants none of whose adjacencies has an N in a probe, a novel sequence of other letters, an alternative chromosome, or
    homology of more than ``most_homology`` bases."""
    bad = (
        F.coalesce(F.contains(F.upper("probe"), F.lit("N")), F.lit(False)) | F.coalesce(F.col("novel_seq").rlike("[^ACGTacgt]"), F.lit(False))
        | is_alternative(F.col("chrom1")) | is_alternative(F.col("chrom2")) | F.coalesce(F.length("homol_seq") > most_homology, F.lit(False))
    )
    parts = variants.select("variant_id", F.explode("adj_ids").alias("adj_id")).join(events.where(bad).select("adj_id"), "adj_id")
    return variants.join(parts.select("variant_id").distinct(), "variant_id", "left_anti")
