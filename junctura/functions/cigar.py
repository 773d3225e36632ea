"""CIGAR strings and alignment blocks.

``cigar`` is an array of (op, len), ``=`` and ``X`` read as ``M``. Blocks are (ts, te, qs, qe), 1-based and inclusive; on the
reverse strand query positions run down.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BLOCKS


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once however often ``use`` names it: Spark works out an expression on arrays at each place where it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_cigar(text: Column) -> Column:
    parts = F.regexp_extract_all(text, F.lit("([0-9]+[MIDNSHPX=])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.translate(F.right(p, F.lit(1)), "=X", "MM").alias("op"), F.left(p, F.length(p) - 1).cast("int").alias("len")))


def _total(cigar: Column, ops: str, other: bool = False) -> Column:
    chosen = lambda x: ~x["op"].isin(*ops) if other else x["op"].isin(*ops)
    return F.aggregate(F.filter(cigar, chosen), F.lit(0), lambda a, x: a + x["len"])


def query_length(cigar: Column) -> Column:
    """Bases of the query, clipped ones too."""
    return _total(cigar, "DNP", other=True)


def matched_length(cigar: Column) -> Column:
    return _total(cigar, "MI")


def indel_length(cigar: Column) -> Column:
    return _total(cigar, "ID")


def target_length(cigar: Column) -> Column:
    return _total(cigar, "MDN")


def effective_edits(nm: Column, cigar: Column) -> Column:
    """Edit distance without inserted and deleted bases."""
    return nm - indel_length(cigar)


def blocks(cigar: Column, pos: Column, strand: Column) -> Column:
    """The matched blocks. Introns shorter than 3 are skipped and do not move the target; an alignment whose first operation
    (after a clip) is no match has no blocks."""
    return once(cigar, lambda c: _blocks(c, pos, strand))


def _blocks(cigar: Column, pos: Column, strand: Column) -> Column:
    forward = strand == "+"
    q0 = F.when(forward, F.lit(1)).otherwise(query_length(cigar)).cast("bigint")
    head = F.get(cigar, F.lit(0))
    clipped = head["op"].isin("S", "H")
    q0 = F.when(clipped, F.when(forward, q0 + head["len"]).otherwise(q0 - head["len"])).otherwise(q0)
    body = F.filter(F.when(clipped, F.slice(cigar, 2, F.greatest(F.size(cigar) - 1, F.lit(0)))).otherwise(cigar), lambda x: ~x["op"].isin("S", "H", "P"))
    sign = F.when(forward, F.lit(1)).otherwise(F.lit(-1)).cast("bigint")
    zero = F.struct(pos.cast("bigint").alias("t"), q0.alias("q"), F.array().cast(BLOCKS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        n = x["len"].cast("bigint")
        t, q, out = acc["t"], acc["q"], acc["out"]
        match, target, insert = x["op"] == "M", (x["op"] == "D") | ((x["op"] == "N") & (n >= 3)), x["op"] == "I"
        block = F.struct(t.alias("ts"), (t + n - 1).alias("te"), q.alias("qs"), (q + sign * (n - 1)).alias("qe"))
        return F.struct(
            F.when(match | target, t + n).otherwise(t).alias("t"),
            F.when(match | insert, q + sign * n).otherwise(q).alias("q"),
            F.when(match, F.concat(out, F.array(block))).otherwise(out).cast(BLOCKS).alias("out"),
        )

    made = lambda body: F.aggregate(body, zero, step, lambda acc: acc["out"])
    return once(body, lambda b: F.when(F.get(b, F.lit(0))["op"] == "M", made(b)).otherwise(F.array().cast(BLOCKS)))


def span(blocks_: Column) -> Column:
    """(tstart, tend, qstart, qend) over all blocks; null for none."""
    ends = lambda a, b: F.concat(F.transform(blocks_, lambda x: x[a]), F.transform(blocks_, lambda x: x[b]))
    return F.struct(F.array_min(ends("ts", "te")).alias("tstart"), F.array_max(ends("ts", "te")).alias("tend"), F.array_min(ends("qs", "qe")).alias("qstart"), F.array_max(ends("qs", "qe")).alias("qend"))


def is_valid(qstart: Column, qend: Column, tstart: Column, tend: Column) -> Column:
    """Starts are positive and ends follow them; nulls are not valid."""
    return F.coalesce((qstart > 0) & (tstart > 0) & (qend > qstart) & (tend > tstart), F.lit(False))


def lift(blocks_: Column, strand: Column, qpos: Column) -> Column:
    """The target position of a query position; null outside the blocks."""
    hit = F.get(F.filter(blocks_, lambda b: qpos.between(F.least(b["qs"], b["qe"]), F.greatest(b["qs"], b["qe"]))), F.lit(0))
    return once(hit, lambda h: F.when(strand == "+", h["ts"] + qpos - h["qs"]).otherwise(h["ts"] + h["qs"] - qpos))


def gaps(blocks_: Column) -> Column:
    """Between consecutive blocks: (i, before, after, tgap, qgap)."""
    return once(blocks_, _gaps)


def _gaps(blocks_: Column) -> Column:
    pairs = F.arrays_zip(F.slice(blocks_, 1, F.greatest(F.size(blocks_) - 1, F.lit(0))).alias("a"), F.slice(blocks_, 2, F.greatest(F.size(blocks_) - 1, F.lit(0))).alias("b"))
    return F.transform(
        pairs,
        lambda p, i: F.struct(
            i.alias("i"), p["a"].alias("before"), p["b"].alias("after"), (p["b"]["ts"] - p["a"]["te"] - 1).alias("tgap"), (F.abs(p["b"]["qs"] - p["a"]["qe"]) - 1).alias("qgap")
        ),
    )


def clipped_ends(seq: Column, qstart: Column, qend: Column, least: int = 15) -> Column:
    """Unaligned ends (side, seq) of at least ``least`` bases that are not mostly one base."""
    from .sequences import is_homopolymer_fragment

    start = F.struct(F.lit("start").alias("side"), F.left(seq, (qstart - 1).cast("int")).alias("seq"))
    end = F.struct(F.lit("end").alias("side"), F.substr(seq, (qend + 1).cast("int")).alias("seq"))
    return F.filter(F.array(start, end), lambda x: (F.length(x["seq"]) >= least) & ~is_homopolymer_fragment(x["seq"]))


def aligned_seq(seq: Column, qstart: Column, qend: Column) -> Column:
    """What an alignment covers of its contig."""
    return F.substr(seq, qstart.cast("int"), (qend - qstart + 1).cast("int"))


def uncovered(spans: Column, start: Column, end: Column) -> Column:
    """The parts (start, end) of a range that no span covers, in order; spans may overlap, touch, or lie outside."""
    kind = "array<struct<start: bigint, end: bigint>>"
    span = lambda a, b: F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("end"))
    zero = F.struct(start.cast("bigint").alias("next"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        low = F.least(x["start"] - 1, end)
        out = F.when(low >= acc["next"], F.concat(acc["out"], F.array(span(acc["next"], low)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["next"], x["end"] + 1).cast("bigint").alias("next"), out.cast(kind).alias("out"))

    ordered = F.array_sort(F.transform(spans, lambda x: span(x["start"], x["end"])))
    return F.aggregate(ordered, zero, step, lambda acc: F.when(acc["next"] <= end, F.concat(acc["out"], F.array(span(acc["next"], end)))).otherwise(acc["out"]))
