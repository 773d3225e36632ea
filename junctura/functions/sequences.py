"""Sequence functions. Each takes and returns columns; nulls give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "agtcAGTC", "tcagTCAG")


def count_of(seq: Column, part: str) -> Column:
    """Occurrences of ``part`` that do not overlap, any case."""
    upper = F.upper(seq)
    return ((F.length(upper) - F.length(F.replace(upper, F.lit(part), F.lit("")))) / len(part)).cast("int")


def is_homopolymer(seq: Column) -> Column:
    """One distinct base, any case."""
    upper = F.upper(seq)
    return (F.length(seq) > 0) & (upper == F.repeat(F.left(upper, F.lit(1)), F.length(seq)))


def is_homopolymer_fragment(seq: Column, share: float = 0.7) -> Column:
    """Whether one base makes up at least ``share`` of the sequence."""
    return F.greatest(*[count_of(seq, b) for b in "ACGT"]) >= F.length(seq) * share


def tandem_unit(seq: Column, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """The shortest unit, of the sizes tried in order, that the whole sequence repeats; null if none does or it comes once."""
    tries = [F.when((F.length(seq) % k == 0) & (F.length(seq) > k) & (seq == F.repeat(F.left(seq, F.lit(k)), (F.length(seq) / k).cast("int"))), F.left(seq, F.lit(k))) for k in sizes]
    return F.coalesce(*tries)


def repeat_unit(seq: Column, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """The base of a homopolymer, else the tandem unit."""
    return F.when(is_homopolymer(seq), F.left(seq, F.lit(1))).otherwise(tandem_unit(seq, sizes))


def copies_before(seq: Column, end: Column, unit: Column) -> Column:
    """Consecutive copies of ``unit`` that end at position ``end`` (1-based), any case."""
    run = F.regexp_extract_all(F.upper(F.left(seq, F.greatest(end, F.lit(0)))), F.concat(F.lit("(?:"), F.upper(unit), F.lit(")+$")), F.lit(0))
    return F.coalesce((F.length(F.get(run, F.lit(0))) / F.length(unit)).cast("int"), F.lit(0))


def copies_after(seq: Column, start: Column, unit: Column, to_end: bool = True) -> Column:
    """Consecutive copies of ``unit`` from position ``start`` (1-based), any case; unless ``to_end``, a copy that ends with the
    sequence does not count."""
    rest = F.upper(F.substr(seq, start))
    run = F.regexp_extract_all(rest, F.concat(F.lit("^(?:"), F.upper(unit), F.lit(")+")), F.lit(0))
    length = F.coalesce(F.length(F.get(run, F.lit(0))), F.lit(0))
    n = (length / F.length(unit)).cast("int")
    return n if to_end else n - F.when((n > 0) & (length == F.length(rest)), 1).otherwise(0)


def pieces(rows: DataFrame, first: int, last: Column, step: int, size: int, keep: list[str], seq: str = "seq", most: int = 200) -> DataFrame:
    """(keep, k, piece): the pieces of ``size`` letters that begin at ``first``, every ``step`` letters, up to the place ``last`` (1-based), which must leave
    room for them. Sequences are cut into stretches of ``most`` pieces before, so that a piece is looked up in a stretch, not in a whole sequence."""
    n = F.floor((last - first) / step) + 1
    held = rows.where(last >= first).withColumn("_n", n)
    stretch = lambda c: F.substr(F.col(seq), (c * (most * step) + first).cast("int"), F.lit((most - 1) * step + size))
    cut_up = held.select(*keep, "_n", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / most).cast("int")), stretch)).alias("_c", "_s"))
    here = F.least(F.lit(most).cast("bigint"), F.col("_n") - F.col("_c") * most).cast("int") - 1
    each = cut_up.select(*keep, "_c", F.posexplode(F.transform(F.sequence(F.lit(0), here), lambda i: F.substr(F.col("_s"), i * step + 1, F.lit(size)))).alias("_i", "piece"))
    return each.select(*keep, (F.col("_c").cast("bigint") * (most * step) + F.col("_i") * step + first).alias("k"), "piece")


def copies_around(rows: DataFrame, first: int, last: Column, step: int, size: int, keep: list[str], seq: str = "seq", most: int = 100_000) -> DataFrame:
    """(keep, k, before, after): of the unit of ``size`` letters at each of the places of ``pieces``, how many copies end before it and follow it. A letter that equals the one ``size`` places on
    continues a run of copies, so the lengths of such runs give both counts at every place of a sequence at once, in time that grows with its length. Up to ``most`` places are sent on at a time."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    held = rows.select(*keep, F.col(seq).alias("_seq"), last.cast("bigint").alias("_last"))  # no filter here: it would work a derived sequence out once more

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts, lasts = batch.column("_seq"), batch.column("_last").to_pylist()
            for row, end in enumerate(lasts):
                if end is None or end < first:
                    continue
                text = texts[row].as_py()
                letters = np.frombuffer(text.encode("utf-32-le"), np.uint32) if not text.isascii() else np.frombuffer(text.encode(), np.uint8)
                letters, n = np.where((letters > 96) & (letters < 123), letters - 32, letters), len(letters)  # any case
                breaks = np.flatnonzero(letters[: n - size] != letters[size:])  # where a letter differs from the one ``size`` on
                bounds = np.concatenate([[-1], breaks, [max(n - size, 0)]])
                for at in range(first, end + 1, step * most):
                    k = np.arange(at, min(end + 1, at + step * most), step)
                    nth = np.searchsorted(bounds, k - 1)
                    after, before = (bounds[nth] - k + 1) // size, (k - 2 - bounds[nth - 1]) // size
                    yield pa.RecordBatch.from_arrays([*(pa.repeat(batch.column(c)[row], len(k)) for c in keep), pa.array(k, pa.int64()), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32))], names=[*keep, "k", "before", "after"])

    return held.mapInArrow(run, ", ".join([*(f"`{c}` {kind[c]}" for c in keep), "k bigint", "before int", "after int"]))


def is_low_complexity(seq: Column, share: float = 0.9) -> Column:
    """Whether one base, or one pair of different bases in the order A, G, T, C, makes up more than ``share``."""
    bases = "AGTC"
    single = [count_of(seq, b) for b in bases]
    pairs = [count_of(seq, bases[i] + bases[j]) * 2 for i in range(4) for j in range(i + 1, 4)]
    return F.greatest(*single, *pairs) > F.length(seq) * share


def tandem_run_near(seq: Column, start: Column, end: Column, window: int = 100, least: int = 4, longest: int = 4) -> Column:
    """Whether a tandem run of at least ``least`` copies of a unit of up to ``longest`` bases overlaps start to end, looking
    ``window`` bases around."""
    first = F.greatest(start - window, F.lit(1))
    part = F.upper(F.substr(seq, first, end + window - first + 1))
    runs = F.regexp_extract_all(part, F.lit(rf"((.{{1,{longest}}}?)\2{{{least - 1},}})"), F.lit(1))
    places = F.transform(runs, lambda r: F.struct(F.position(r, part).alias("at"), F.length(r).alias("n")))
    low, high = start - first + 1, end - first + 1
    return F.exists(places, lambda p: (p["at"] <= high + 1) & (p["at"] + p["n"] >= low))


def novel_repeats_nearby(seq: Column, novel: Column, break1: Column, break2: Column, least: int = 3) -> Column:
    """Whether another copy of the novel sequence touches or overlaps the break in the contig; sequences of up to ``least``
    bases are not looked for."""
    n = F.length(novel)
    low, high = break1, break2 - 2
    starts = F.sequence(F.greatest(low - n, F.lit(0)), F.least(high + 1, F.length(seq) - n))
    touches = lambda i: (i != low) & (F.substr(F.upper(seq), (i + 1).cast("int"), n) == F.upper(novel)) & (F.least(i + n - 1, high) - F.greatest(i, low) >= -1)
    return F.when((n > least) & (F.length(seq) >= n) & (F.least(high + 1, F.length(seq) - n) >= F.greatest(low - n, F.lit(0))), F.exists(starts, touches)).otherwise(False)


def probe(seq: Column, break1: Column, break2: Column, flank: int = 25) -> Column:
    """``flank`` bases up to the first contig break and from the second on; NA where no contig is given."""
    low, high = F.least(break1, break2), F.greatest(break1, break2)
    first = F.greatest(low - flank + 1, F.lit(1))
    return F.upper(F.substr(seq, first, F.least(high + flank - 1, F.length(seq)) - first + 1))


def balanced_probe(seq: Column, break1: Column, break2: Column, flank: int = 50) -> Column:
    """``flank`` bases on each side of the breaks; what one side lacks the other side adds."""
    low, high = F.least(break1, break2), F.greatest(break1, break2)
    left, right = F.least(low, F.lit(flank)), F.least(F.length(seq) - high + 1, F.lit(flank))
    first = F.greatest(low - left - (flank - right) + 1, F.lit(1))
    last = F.least(high + right + (flank - left) - 1, F.length(seq))
    return F.substr(seq, first, last - first + 1)


def differences(a: Column, b: Column) -> Column:
    """Positions (1-based) at which two sequences differ, up to the shorter one's end."""
    pairs = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    return F.filter(pairs, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))


def exact_matches(seq: Column, pattern: Column) -> Column:
    """All places (start, strand) of a pattern, those that overlap too; the reverse strand only if the forward one has none."""
    places = lambda p: F.filter(F.sequence(F.lit(1), F.greatest(F.length(seq) - F.length(p) + 1, F.lit(1))), lambda i: F.substr(seq, i, F.length(p)) == p)
    mark = lambda found, s: F.transform(found, lambda i: F.struct(i.alias("start"), F.lit(s).alias("strand")))
    forward = places(pattern)
    return F.when(F.size(forward) > 0, mark(forward, "+")).otherwise(mark(places(reverse_complement(pattern)), "-"))


# The standard genetic code, bases in the order T, C, A, G.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate_codons(seq: Column, frame: int = 0) -> Column:
    """Amino acids of the whole codons from ``frame`` (0 to 2) on; * is a stop, X a codon with another character."""
    number = lambda c: F.instr(F.lit("TCAG"), c) - 1
    at = lambda i, k: number(F.substr(F.upper(seq), i + k, F.lit(1)))
    codon = lambda i: F.when((at(i, 0) < 0) | (at(i, 1) < 0) | (at(i, 2) < 0), "X").otherwise(F.substr(F.lit(AMINO_ACIDS), (16 * at(i, 0) + 4 * at(i, 1) + at(i, 2) + 1).cast("int"), F.lit(1)))
    whole = ((F.length(seq) - frame) / 3).cast("int")
    starts = F.transform(F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0))), lambda k: k * 3 + frame + 1)
    return F.when(whole > 0, F.array_join(F.transform(starts, codon), "")).otherwise("")


def _stretch(strand: str, frame: int):
    return lambda p: F.struct((-F.length(p)).alias("order"), F.lit(strand).alias("strand"), F.lit(frame).alias("frame"), p.alias("aa"))


def open_frames(seq: Column, least: int = 2) -> Column:
    """Stop-free stretches of amino acids in all six frames, longest first, then by strand and frame."""
    found = []
    for strand, s in (("+", seq), ("-", reverse_complement(seq))):
        for frame in range(3):
            parts = F.split(translate_codons(s, frame), r"\*")
            found.append(F.transform(parts, _stretch(strand, frame)))
    return F.transform(F.array_sort(F.filter(F.concat(*found), lambda x: x["order"] <= -least)), lambda x: x.dropFields("order"))
