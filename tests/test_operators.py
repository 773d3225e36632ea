"""Operators against plain models on small made-up inputs."""

import random
import struct
import zlib

from pyspark.sql import functions as F

from junctura.functions import cigar as C
from junctura.functions import coords
from junctura.functions import sequences as Q
from junctura.functions import transcripts as X
from junctura.operators import adjacency as A
from junctura.operators import exons as E
from junctura.operators import fusion as U
from junctura.operators import intervals as I
from junctura.operators import rescue as H
from junctura.operators import segments as S
from junctura.operators import splice as P
from junctura.operators import support as R


def plain_blocks(cigar, pos, strand):
    ops = [(c[-1], int(c[:-1])) for c in cigar]
    size = sum(n for o, n in ops if o not in "DNP")
    q, step = (1, 1) if strand == "+" else (size, -1)
    if ops[0][0] in "SH":
        q += step * ops[0][1]
        ops = ops[1:]
    out, t = [], pos
    ops = [x for x in ops if x[0] not in "SHP"]
    if not ops or ops[0][0] != "M":
        return []
    for o, n in ops:
        if o == "M":
            out.append((t, t + n - 1, q, q + step * (n - 1)))
        if o in "MD" or (o == "N" and n >= 3):
            t += n
        if o in "MI":
            q += step * n
    return out


def test_blocks_equal_a_plain_walk(spark):
    r = random.Random(1)
    rows = []
    for i in range(150):
        body = [f"{r.randrange(1, 30)}{r.choice('MMMDIN')}" for _ in range(r.randrange(1, 7))]
        parts = [f"{r.randrange(1, 9)}S"] * r.randrange(2) + body + [f"{r.randrange(1, 9)}H"] * r.randrange(2)
        rows.append((i, parts, r.randrange(1, 1000), r.choice("+-")))
    df = spark.createDataFrame([(i, "".join(p), pos, s) for i, p, pos, s in rows], "i int, c string, pos bigint, strand string").withColumn("cigar", C.parse_cigar(F.col("c")))
    got = {x.i: [tuple(b) for b in x.b] for x in df.select("i", C.blocks(F.col("cigar"), F.col("pos"), F.col("strand")).alias("b")).collect()}
    assert got == {i: plain_blocks(p, pos, s) for i, p, pos, s in rows}


def test_sequence_functions(spark):
    row = spark.createDataFrame([("AACAGCAGCAGTT", "CAG", None)], "s string, u string, n string")
    c = F.col
    got = row.select(
        Q.reverse_complement(c("s")).alias("rc"), Q.tandem_unit(F.lit("CAGCAG"), (2, 3, 4)).alias("u1"), Q.tandem_unit(F.lit("CAGCA")).alias("u2"), Q.is_homopolymer(F.lit("AAa")).alias("h"), Q.copies_after(c("s"), F.lit(3), c("u")).alias("after"),
        Q.copies_before(c("s"), F.lit(11), c("u")).alias("before"), Q.copies_after(F.lit("CAGCAG"), F.lit(1), c("u"), to_end=False).alias("short"), Q.reverse_complement(c("n")).alias("none"), Q.probe(F.lit("A" * 30 + "C" * 30), F.lit(30), F.lit(31), 5).alias("probe"),
        Q.translate_codons(F.lit("ATGTAAGGN")).alias("aa"), F.transform(Q.exact_matches(F.lit("AAAA"), F.lit("AA")), lambda x: x["start"]).alias("m"), F.get(Q.exact_matches(F.lit("GGAC"), F.lit("TCC")), F.lit(0)).alias("r"),
        Q.is_low_complexity(F.lit("AGAGAGAGAG")).alias("low"), Q.tandem_run_near(F.lit("TTCCGAGAGAGAGACCTT"), F.lit(8), F.lit(9)).alias("run"), Q.differences(F.lit("ACGT"), F.lit("AGGA")).alias("d"), Q.balanced_probe(F.lit("ACGTACGTAC"), F.lit(2), F.lit(3), 4).alias("bp"),
    ).first()
    assert (got.rc, got.u1, got.u2, got.h, got.after, got.before, got.short, got.none) == ("AACTGCTGCTGTT", "CAG", None, True, 3, 3, 1, None)
    assert (got.probe, got.aa, got.m, tuple(got.r), got.low, got.run, got.d, got.bp) == ("AAAAACCCCC", "M*X", [1, 2, 3], (1, "-"), True, True, [2, 4], "ACGTACGT")
    frames = spark.range(1).select(Q.open_frames(F.lit("ATGGCCTAAATG"), 2).alias("o")).first().o
    assert [len(x.aa) for x in frames] == sorted((len(x.aa) for x in frames), reverse=True) and any(x.aa == "MA" and x.strand == "+" and x.frame == 0 for x in frames)


def test_chromosome_order(spark):
    df = spark.createDataFrame([("chr10",), ("chr2",), ("X",), ("chr1",), ("MT",)], "c string")
    assert [r.c for r in df.orderBy(coords.chrom_key(F.col("c"))).collect()] == ["chr1", "chr2", "chr10", "MT", "X"]
    got = spark.createDataFrame([("chr1_random",), ("chr12",), ("chrX",), ("GL000",), (None,)], "c string").select(coords.is_canonical(F.col("c")).alias("k")).collect()
    assert [r.k for r in got] == [False, True, True, False, None]


def test_classification_follows_the_table(spark):
    seg = lambda i, q, t, s, qs, qe, ts, te: (i, q, t, s, qs, qe, ts, te)
    rows = [
        seg(1, "trl", "chr1", "+", 1, 50, 100, 149), seg(2, "trl", "chr2", "+", 51, 100, 500, 549), seg(3, "inv", "chr1", "+", 1, 50, 100, 149), seg(4, "inv", "chr1", "-", 51, 100, 500, 549),
        seg(5, "del", "chr1", "+", 1, 50, 100, 149), seg(6, "del", "chr1", "+", 51, 100, 500, 549), seg(7, "dup", "chr1", "+", 1, 50, 500, 549), seg(8, "dup", "chr1", "+", 51, 100, 400, 449),
        seg(9, "ins", "chr1", "+", 1, 50, 100, 149), seg(10, "ins", "chr1", "+", 61, 100, 150, 189), seg(11, "homdel", "chr1", "+", 1, 55, 100, 149), seg(12, "homdel", "chr1", "+", 51, 100, 150, 199),
    ]
    df = spark.createDataFrame(rows, "seg_id bigint, query string, target string, strand string, qstart bigint, qend bigint, tstart bigint, tend bigint")
    got = {r.query: r for r in S.classify(S.consecutive(df)).collect()}
    assert {k: r.rearrangement for k, r in got.items()} == {"trl": "trl", "inv": "inv", "del": "del", "dup": "dup", "ins": "ins", "homdel": "del"}
    assert (got["homdel"].break1, got["homdel"].break2, got["homdel"].homol1) == (151, 149 + 55 - 51 + 1, None)
    assert (got["dup"].break1, got["dup"].orient1, got["dup"].break2, got["dup"].orient2) == (400, "R", 549, "L")


def plain_pairs(rows, most=25):
    out, i = [], 0
    rows = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    while i < len(rows) - 1:
        a, b = rows[i], rows[i + 1]
        if a[1] == b[1] and b[2] - a[2] <= most and {a[3], b[3]} == {"LL", "RR"}:
            out.append((a[0], b[0]) if a[3] == "LL" else (b[0], a[0]))
            i += 2
        else:
            i += 1
    return sorted(out)


def test_pairing_equals_the_greedy_loop(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["chr1", "chr2"]), r.randrange(0, 900), r.choice(["LL", "RR"])) for i in range(200)]
    df = spark.createDataFrame([(i, "inv", c, b, o[0], c, b + 100, o[1]) for i, c, b, o in rows], "adj_id bigint, rearrangement string, chrom1 string, break1 bigint, orient1 string, chrom2 string, break2 bigint, orient2 string")
    assert sorted((x.adj1, x.adj2) for x in A.pair_inversions(df).collect()) == plain_pairs(rows)


def test_numbering_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "a int, b int").repartition(5)
    got = sorted((r.n, r.a) for r in A.number(df, ["a"], "n").collect())
    assert got == [(i + 1, i) for i in range(101)]


def test_interval_join_equals_nested_loops(spark):
    r = random.Random(3)
    make = lambda n: [(i, r.choice("ab"), s := r.randrange(0, 5000), s + r.randrange(0, 1500)) for i in range(n)]
    left, right = make(80), make(80)
    a, b = spark.createDataFrame(left, "i int, c string, s int, e int"), spark.createDataFrame(right, "j int, d string, t int, u int")
    got = sorted((x.i, x.j) for x in I.overlap_join(a, b, [("c", "d")], ("s", "e"), ("t", "u"), 300).collect())
    assert got == sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    total = {x.c: x.covered for x in I.union_length(a, ["c"], "s", "e").collect()}
    assert total == {k: len({p for _, c, s, e in left if c == k for p in range(s, e + 1)}) for k in "ab"}


def test_spanning_reads_equal_the_sequential_count(spark):
    r = random.Random(4)
    reads = [(n, f"r{r.randrange(60)}", r.choice("xy"), s := r.randrange(1, 60), s + r.randrange(20, 60), r.choice("+-"), r.random() < 0.9) for n in range(400)]
    spans = [(c, s, s + r.randrange(0, 5)) for c in "xy" for s in (30, 45, 60)]
    df = spark.createDataFrame(reads, "seq_no bigint, name string, contig string, rstart bigint, rend bigint, strand string, whole boolean")
    got = {(x.contig, x.span1): x.spanning for x in R.spanning(spark.createDataFrame(spans, "contig string, span1 bigint, span2 bigint"), df, width=25).collect()}
    want = {}
    for c, a, b in spans:
        keys, names = set(), set()
        for _, name, contig, s, e, strand, whole in reads:
            if contig == c and whole and s <= a - 1 and e >= b + 1 and (s, strand) not in keys and name not in names:
                keys.add((s, strand))
                names.add(name)
        if keys:
            want[(c, a)] = len(keys)
    assert got == want


def test_transcript_coordinates(spark):
    row = spark.createDataFrame([("+", [(101, 110), (201, 230)], 105, 220), ("-", [(101, 110), (201, 230)], 220, 105)], "strand string, exons array<struct<start: bigint, end: bigint>>, cs bigint, ce bigint")
    c = F.col
    got = row.select("strand", X.to_genome(c("exons"), c("strand"), F.lit(12)).alias("g"), X.to_transcript(c("exons"), c("strand"), F.lit(205)).alias("t"), X.exon_at(c("exons"), c("strand"), F.lit(205)).alias("n"), X.within_utr(c("exons"), c("strand"), c("cs"), c("ce"), F.lit(102)).alias("u"), X.length(c("exons")).alias("l"), X.to_transcript(c("exons"), c("strand"), F.lit(150)).alias("none"), X.codon_in_genome(c("exons"), c("strand"), c("cs"), c("ce"), F.lit(1)).alias("codon")).collect()
    assert [tuple(r) for r in got] == [("+", 202, 15, 2, 5, 40, None, [105, 106, 107]), ("-", 219, 26, 1, None, 40, None, [220, 219, 218])]


def test_codes_score_and_full_match(spark):
    df = spark.createDataFrame([(1, "chr1", 101, 230, [(101, 110, 1, 10), (201, 230, 11, 40)]), (2, "chr1", 95, 225, [(95, 205, 1, 111), (221, 225, 112, 116)])], "seg_id bigint, target string, tstart bigint, tend bigint, blocks array<struct<ts: bigint, te: bigint, qs: bigint, qe: bigint>>")
    tx = spark.createDataFrame([("t", "g", "chr1", "+", True, 105, 220, [(101, 110), (201, 230)])], "tid string, gene string, chrom string, strand string, coding boolean, cds_start bigint, cds_end bigint, exons array<struct<start: bigint, end: bigint>>")
    mapped = E.map_alignments(df, tx)
    got = {r.seg_id: r for r in mapped.select("seg_id", "codes", E.score(F.col("codes")).alias("s"), E.is_full_match(F.col("codes")).alias("f"), E.coverage(F.col("blocks"), F.col("exons")).alias("c")).collect()}
    assert [[tuple(m) for m in b] for b in got[1].codes] == [[(0, "==")], [(1, "==")]] and got[1].s == 2 + 8 + 2 + 8 and got[1].f and got[1].c == 1.0
    assert 2 not in got


def test_splice_motif(spark):
    c = lambda d, a, s: P.motif_of(F.lit(d), F.lit(a), F.lit(s), F.lit(50))
    got = spark.range(1).select(c("gt", "ag", "+").alias("a"), c("AC", "CT", "-").alias("b"), c("GC", "AG", "+").alias("c"), c("GC", "AT", "+").alias("d"), P.implied_variants(F.lit("chr1"), F.lit("+"), F.lit("GC"), F.lit("AG"), F.lit(11), F.lit(60), c("GC", "AG", "+")).alias("v")).first()
    assert (got.a.motif, got.b.motif, got.c.motif, got.d, got.v) == ("GTAG", "GTAG", "GCAG", None, ["chr1:12C>T"])


def test_fusion_rules(spark):
    got = spark.range(1).select(U.sense_by_genome(F.lit("+"), F.lit("L"), F.lit("-"), F.lit("L")).alias("a"), U.sense_by_genome(F.lit("-"), F.lit("L"), F.lit("+"), F.lit("L")).alias("b"), U.sense_by_genome(F.lit("+"), F.lit("L"), F.lit("+"), F.lit("L")).alias("c"), U.within_gene(F.lit("dup"), F.lit(True), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(True), F.lit(False)).alias("d"), H.clip_break(C.parse_cigar(F.lit("30M20S")), F.lit(5), F.lit(34)).alias("e")).first()
    assert (got.a, got.b, got.c, got.d, tuple(got.e)) == (1, 2, None, "ITD", (34, "L"))
    assert U.shift_to_end("ATGCAGCAGCAGTTT", 3) == 6 and U.shift_to_end("ATG", 0) == 0
    left, right = "ATGGCTGCAAAATGTCTGGAT", "GTTCATCGTTGGACCGATAAA"
    assert U.in_frame(left + right, 21, 22, "MAAKCLD", "VHRWTDK") and not U.in_frame(left + "A" + right, 21, 23, "MAAKCLD", "VHRWTDK")


def test_readers_and_writers(spark, tmp_path):
    from junctura.sinks import vcf
    from junctura.sources import text

    (tmp_path / "a.sam").write_text("@SQ\tSN:chr1\tLN:9\nq1\t16\tchr1\t5\t60\t3S4M\t=\t9\t7\tACGTACG\tIIIIIII\tNM:i:1\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    rows = {r["query"]: r for r in text.sam(spark, str(tmp_path / "a.sam")).collect()}
    assert (rows["q1"].target, rows["q1"].nm, rows["q1"].mate_target, [tuple(x) for x in rows["q1"].cigar]) == ("chr1", 1, "chr1", [("S", 3), ("M", 4)]) and rows["q2"].target is None
    (tmp_path / "a.fa").write_text(">one first record\nACGT\nAC\n>two\nTTTT\n")
    genome = text.fasta(spark, str(tmp_path / "a.fa"))
    assert sorted((r["name"], r.description, r.seq) for r in genome.collect()) == [("one", "first record", "ACGTAC"), ("two", "", "TTTT")]
    spans = spark.createDataFrame([(1, "one", 2, 5)], "k int, chrom string, start bigint, end bigint")
    assert text.fetch(spans, text.chunked(genome, 3), 3, ["k"]).first().seq == "CGTA"
    (tmp_path / "a.gtf").write_text('#c\nchr1\ts\texon\t1\t10\t.\t+\t.\tgene_id "G"; transcript_id "T";\nchr1\ts\texon\t21\t30\t.\t+\t.\tgene_id "G"; gene_name "N"; transcript_id "T";\n')
    assert sorted((r.start, r.gene, r.tid) for r in text.gtf(spark, str(tmp_path / "a.gtf")).collect()) == [(1, "G", "T"), (21, "N", "T")]
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\n1\t5\t.\tA\tT\t.\t.\tDP=3;SOMATIC\n")
    got = text.vcf(spark, str(tmp_path / "a.vcf")).first()
    assert (got.pos, got.info) == (5, {"DP": "3", "SOMATIC": None})
    records = spark.createDataFrame([("2", 30, "x", "A", "T", "I"), ("10", 4, "y", "C", "G", "J")], "chrom string, pos bigint, id string, ref string, alt string, info string")
    vcf.write(records, str(tmp_path / "v"), vcf.header("here"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert lines[0].startswith("##fileformat") and [x for x in lines if not x.startswith("#")] == ["10\t4\ty\tC\tG\t.\t.\tJ", "2\t30\tx\tA\tT\t.\t.\tI"]


def bgzf(data: bytes) -> bytes:
    out = b""
    for part in (data[:40], data[40:], b""):
        packed = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packed.compress(part) + packed.flush()
        out += b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_bam_source(spark, tmp_path):
    from junctura.sources.bam import BamDataSource

    name, cigar, seq = b"read1\0", struct.pack("<2I", (3 << 4) | 4, (4 << 4) | 0), bytes([0x12, 0x48, 0x12, 0x40])
    body = struct.pack("<iiBBHHHiiii", 0, 4, len(name), 60, 0, 2, 16, 7, 0, 8, 7) + name + cigar + seq + b"\x1e" * 7 + b"NMC\x01"
    content = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000) + struct.pack("<i", len(body)) + body
    (tmp_path / "a.bam").write_bytes(bgzf(content))
    spark.dataSource.register(BamDataSource)
    got = spark.read.format("bam").load(str(tmp_path)).collect()
    assert [(r["query"], r.flag, r.target, r.pos, r.seq, r.nm, [tuple(x) for x in r.cigar]) for r in got] == [("read1", 16, "chr1", 5, "ACGTACG", 1, [("S", 3), ("M", 4)])]


def test_genome_plan_from_alignments(spark):
    from junctura.plans import genome

    rows = [(1, "c1", 0, "chr1", 101, 60, "50M50S"), (2, "c1", 0, "chr1", 501, 60, "50S50M"), (3, "c2", 0, "chr2", 11, 60, "40M10D40M")]
    df = spark.createDataFrame([(*r, "ACGTTGCA" * 12 + "ACGT", 0) for r in rows], "seq_no bigint, query string, flag int, target string, pos bigint, mapq int, c string, seq string, nm int").withColumn("cigar", C.parse_cigar(F.col("c")))
    contigs = spark.createDataFrame([("c1", "ACGTTGCA" * 12 + "ACGT"), ("c2", "ACGTTGCA" * 10)], "name string, seq string")
    df = df.withColumn("seq", F.when(F.col("query") == "c2", F.lit("ACGTTGCA" * 10)).otherwise(F.col("seq"))).withColumn("nm", F.when(F.col("query") == "c2", 10).otherwise(0))
    got = {(r["query"], r.rearrangement, r.break1, r.break2, r["size"]) for r in genome.events(df, contigs).collect()}
    assert got == {("c1", "del", 150, 501, 350), ("c2", "del", 50, 61, 10)}
