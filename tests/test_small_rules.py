"""Rules, parsers and renderings that plans use in passing, each on rows whose result is plain to see."""

from pyspark.sql import functions as F

from junctura import schemas
from junctura.functions import cigar as C
from junctura.functions import sequences as Q
from junctura.functions import transcripts as X
from junctura.operators import adjacency as A
from junctura.operators import exons as E
from junctura.operators import fusion as U
from junctura.operators import rescue as H
from junctura.operators import splice as P
from junctura.operators import support as R
from junctura.operators import variants as V
from junctura.sinks import tables as T
from junctura.sources import text

EXON = "array<struct<start: bigint, end: bigint>>"


def one(spark, **columns):
    """The values of columns, computed on a single row."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def lit(*values):
    return [F.lit(v) for v in values]


def test_rules_of_events(spark):
    bounds = lambda *x: F.array(*lit(*x))
    event = lambda b1, b2, strand, m1, m2: U.spliced_deletion(F.lit("del"), F.lit(b1), F.lit(b2), F.lit(strand), F.lit(m1), F.lit(m2))
    got = one(
        spark,
        skipped=event(True, True, "+", "GT", "AC"), donor=event(False, True, "+", "gt", "xx"), acceptor=event(True, False, "+", "xx", "ac"), minus=event(True, False, "-", "GT", "xx"), none=event(False, True, "+", "GC", "xx"), other=U.spliced_deletion(F.lit("dup"), F.lit(True), F.lit(True), *lit("+", "GT", "AC")),
        both=U.slide_to_bound(F.lit(100), F.lit(200), F.lit(3), bounds(102, 99), bounds(202)), single=U.slide_to_bound(F.lit(100), F.lit(200), F.lit(3), bounds(99), bounds(250)), nowhere=U.slide_to_bound(F.lit(100), F.lit(200), F.lit(3), bounds(110), bounds(250)),
        again=U.insertion_as_duplication(F.lit("AAACCGTCCGTAAA"), F.lit("CCGT"), F.lit(7), F.lit(12)), trimmed=U.insertion_as_duplication(F.lit("AAACCGACCGTAAA"), F.lit("CCGT"), F.lit(7), F.lit(12)), fresh=U.insertion_as_duplication(F.lit("AAATTTTCCGTGAA"), F.lit("CCGT"), F.lit(7), F.lit(12)),
        inside=U.inverted_duplication(*lit(100, 200, 150, 190)), equal=U.inverted_duplication(*lit(100, 200, 100, 200)), outside=U.inverted_duplication(*lit(100, 200, 190, 210)),
        dup=A.transcript_size(F.lit("ITD"), F.lit(True), *lit(50, 51, 30, 41, 0, 0), F.lit("AC"), F.lit(None).cast("string")), dele=A.transcript_size(F.lit("del"), F.lit(True), *lit(50, 51, 0, 0, 100, 111), F.lit(None).cast("string"), F.lit("A")), ins=A.transcript_size(F.lit("ins"), F.lit(True), *lit(50, 61, 0, 0, 0, 0), F.lit(None).cast("string"), F.lit(None).cast("string")), fusion=A.transcript_size(F.lit("fusion"), F.lit(False), *lit(1, 2, 3, 4, 5, 6), F.lit("A"), F.lit("A")),
        kept=H.frame_of(F.lit(10), F.lit(4)), broken=H.frame_of(F.lit(10), F.lit(5)),
    )
    assert [got[k] for k in ("skipped", "donor", "acceptor", "minus", "none", "other")] == ["skipped_exon", "alt_donor", "alt_acceptor", "alt_donor", "del", "dup"]
    assert tuple(got["both"]) == (2, 102, 202) and tuple(got["single"]) == (-1, 99, 199) and got["nowhere"] is None
    assert (got["again"], got["trimmed"], got["fresh"]) == (True, True, False)
    assert (got["inside"], got["equal"], got["outside"]) == (True, False, False)
    assert (got["dup"], got["dele"], got["ins"], got["fusion"]) == (14, 11, 10, None) and got["kept"] and not got["broken"]


def test_rules_of_transcripts_and_sequences(spark):
    ex = F.expr("array(named_struct('start', 101L, 'end', 110L), named_struct('start', 201L, 'end', 220L))")
    got = one(
        spark, first=X.exon_number(ex, F.lit("+"), F.lit(0)), last=X.exon_number(ex, F.lit("-"), F.lit(0)), exon=X.exon(ex, F.lit("-"), F.lit(1)), beyond=X.exon(ex, F.lit("+"), F.lit(3)), aa=X.amino_acid(F.lit(7)), codon=X.codon(F.lit(3)),
        cds=X.cds_exons(ex, F.lit(105), F.lit(210)), start=X.at_exon_bound(ex, F.lit(201), F.lit("start")), end=X.at_exon_bound(ex, F.lit(201), F.lit("end")),
        ends=C.clipped_ends(F.lit("ACGTTGCAGATCGATTACCGG" + "A" * 30), F.lit(21), F.lit(30)), valid=C.is_valid(*lit(1, 10, 5, 14)), bad=C.is_valid(*lit(10, 1, 5, 14)),
        near=Q.novel_repeats_nearby(F.lit("TTTTACGTACGTTTTT"), F.lit("ACGT"), F.lit(4), F.lit(9)), far=Q.novel_repeats_nearby(F.lit("TTTTACGTTTTTACGT"), F.lit("ACGT"), F.lit(4), F.lit(9)), short=Q.novel_repeats_nearby(F.lit("ACACAC"), F.lit("AC"), F.lit(2), F.lit(5)),
    )
    assert (got["first"], got["last"], tuple(got["exon"]), got["beyond"], got["aa"], tuple(got["codon"])) == (1, 2, (201, 220), None, 3, (7, 9))
    assert [tuple(x) for x in got["cds"]] == [(105, 110), (201, 210)] and got["start"] and not got["end"]
    assert [tuple(x) for x in got["ends"]] == [("start", "ACGTTGCAGATCGATTACCG")] and got["valid"] and not got["bad"]
    assert got["near"] and not got["far"] and not got["short"]


def test_transcript_sequences_over_chunks(spark):
    whole = "ACGTTGCAGATCGATTACCGGATACCATTG"
    genome = spark.createDataFrame([("chr1", i, whole[10 * i : 10 * i + 10]) for i in range(3)], "name string, chunk_no bigint, seq string")
    tx = spark.createDataFrame([("a", "A", "chr1", "+", True, 5, 22, [(3, 12), (19, 25)]), ("b", "B", "chr1", "-", False, None, None, [(3, 12), (19, 25)])], schemas.TRANSCRIPTS)
    joined = whole[2:12] + whole[18:25]
    flip = joined[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert {r.tid: r.seq for r in E.transcript_sequences(tx, genome, 10).collect()} == {"a": joined, "b": flip}
    assert {r.tid: r.seq for r in E.transcript_sequences(tx, genome, 10, only_cds=True).collect()} == {"a": whole[4:12] + whole[18:22]}


def test_shared_events_and_mates(spark):
    events = spark.createDataFrame([("del", "1", 5, "1", 9, "k1"), ("del", "1", 5, "1", 9, "k2"), ("dup", "1", 5, "1", 9, "k1")], "event string, chrom1 string, break1 long, chrom2 string, break2 long, query string")
    assert [(r.event, r.contigs) for r in U.multi_contig_events(events).collect()] == [("del", 2)]
    reads = spark.createDataFrame([("r1", 1, 0, "t1", "A"), ("r1", 2, 4, None, "C"), ("r2", 1, 4, None, "G"), ("r2", 2, 4, None, "T")], "name string, mate int, flag int, target string, seq string")
    assert [tuple(r) for r in H.mates_without_target(reads).collect()] == [("r1", 2, "C", "t1")]
    shifts = spark.createDataFrame([(1, "ATGCAGCAGCAGTAA", 4), (2, "ATGCAGCAGCAGTAA", 5), (3, None, 4)], "event_id int, cds string, cds_break int")
    assert {r.event_id: r.shift for r in U.shifted_repeats(shifts).collect()} == {1: 6, 2: 0, 3: 0}


def test_variants_that_probes_speak_against(spark):
    variants = spark.createDataFrame([("v1", [1]), ("v2", [2]), ("v3", [3, 4]), ("v4", [5])], "variant_id string, adj_ids array<bigint>")
    events = spark.createDataFrame([(1, "split", "ACGT", None, "chr1", "chr2", None), (2, "gapped", "ACNT", None, "chr1", "chr1", None), (3, "split", "ACGT", "AC-", "chr1", "chr1", None), (4, "split", "ACGT", "AC", "chr1", "chr1", None), (5, "gapped", "ACGT", "AC", "chr1", "chr1_alt", None)], "adj_id bigint, align_type string, probe string, novel_seq string, chrom1 string, chrom2 string, homol_seq string")
    assert sorted(r.variant_id for r in A.sound_variants(variants, events).collect()) == ["v1"]
    hits = [(1, [("M", 50)], False), (2, [("M", 20), ("I", 1), ("M", 20)], False), (4, [("S", 5), ("M", 20)], False), (5, [("M", 9)], True)]
    found = spark.createDataFrame(hits, "adj_id bigint, cigar array<struct<op: string, len: int>>, unmapped boolean")
    assert sorted(r.variant_id for r in V.without_realigned(variants, events, found).collect()) == ["v2", "v3", "v4"]


def test_retained_introns_and_linked_rows(spark):
    codes = "array<array<struct<exon: int, code: string>>>"
    rows = [(1, "chr1", "t", [(101, 200), (301, 400)], [[(0, "=>"), (1, "<=")]]), (2, "chr1", "t", [(101, 200), (301, 400)], [[(0, "==")], [(1, "==")]]), (3, "chr1", "u", [(1001, 1100), (1301, 1400)], [[(0, "=>"), (1, "<=")]])]
    mapped = spark.createDataFrame(rows, f"seg_id bigint, target string, tid string, exons {EXON}, codes {codes}")
    known = spark.createDataFrame([("chr1", 950, 1500)], "chrom string, start bigint, end bigint")
    assert [(r.seg_id, r.pos1, r.pos2, r["size"]) for r in P.retained_introns(mapped, known).collect()] == [(1, 200, 301, 100)]
    events = spark.createDataFrame([(1, "retained_intron", 9), (2, "skipped_exon", 9)], "event_id bigint, event string, spanning int")
    assert sorted((r.event_id, r.part or 0, r.link_id) for r in P.split_in_two(events).collect()) == [(1, 1, 1), (1, 2, 1), (2, 0, None)]


def test_tiles(spark):
    spans = spark.createDataFrame([("c", 10, 30), ("c", 50, 60)], "contig string, span1 bigint, span2 bigint")
    reads = spark.createDataFrame([("c", 5, 20, True), ("c", 21, 35, True), ("c", 45, 53, True), ("c", 56, 70, True)], "contig string, rstart bigint, rend bigint, whole boolean")
    assert {(r.span1, r.tiled) for r in R.tiled(spans, reads).collect()} == {(10, True), (50, False)}


def lines(rows):
    return sorted(r.value for r in rows.collect())


def test_parsers(spark, tmp_path):
    def file(name, content):
        (tmp_path / name).write_text(content)
        return str(tmp_path / name)

    bands = text.cytobands(spark, file("bands", "chr1\t0\t100\tp1\tgneg\nchr1\t100\t200\tp2\tacen\n")).collect()
    assert [(r.chrom, r.start, r.end) for r in bands] == [("chr1", 101, 200)]
    assert [tuple(r) for r in text.coordinates(spark, file("coords", "k1\t9\t5\tsplit\n")).collect()] == [("k1", 5, 9, "split")]
    assert [tuple(r) for r in text.support(spark, file("support", "k1\t5-9\t3\t2\n")).collect()] == [("k1", 5, 9, 3, 2)]
    assert sorted(r.name for r in text.names(spark, file("names", "a\n\n b \na\n")).collect()) == ["a", "b"]
    hit = "q{}\tt\t99.0\t{}\t0\t0\t1\t{}\t1\t50\t1e-9\t90\t50\n"
    hits = file("hits", hit.format(1, 50, 50) + hit.format(2, 45, 45))
    assert [r["query"] for r in text.blast(spark, hits).collect()] == ["q1"] and text.blast(spark, hits, most_clipped=5).count() == 2
    assert [tuple(r) for r in text.bedpe(spark, file("bedpe", "chrom1\tstart1\nchr1\t7\n"), ["chrom1", "start1"]).collect()] == [("chr1", "7")]


def test_renderings(spark):
    adj = spark.createDataFrame([(1, "del", "chr1", 5, "L", "chr1", 9, "R", "k1", 3, 4, "gapped")], "adj_id bigint, rearrangement string, chrom1 string, break1 bigint, orient1 string, chrom2 string, break2 bigint, orient2 string, contig string, cb1 bigint, cb2 bigint, align_type string")
    assert lines(T.break_bed(adj)) == ["chr1\t4\t5\tdel-chr1-5-L-chr1-9-R", "chr1\t8\t9\tdel-chr1-5-L-chr1-9-R"]
    variants = spark.createDataFrame([("v", [1])], "variant_id string, adj_ids array<bigint>")
    assert lines(T.coordinate_lines(variants, adj)) == ["k1\t3\t4\tgapped"]
    support = spark.createDataFrame([("k1", 5, 9, 3, 2)], "contig string, span1 bigint, span2 bigint, spanning int, flanking int")
    assert lines(T.support_lines(support)) == ["k1\t5-9\t3\t2"]
    event = spark.createDataFrame([("chr1", 5, "chr2", 9, 7, "fusion", "A")], "chrom1 string, break1 bigint, chrom2 string, break2 bigint, report_id bigint, event string, gene1 string")
    row = lines(T.transcript_bedpe(event))[0].split("\t")
    assert len(row) == 44 and row[:8] == ["chr1", "4", "5", "chr2", "8", "9", "7", "."] and row[14] == "A" and row[15] == "na"
    splice = lines(T.splice_bedpe(event.withColumn("name", F.lit("n"))))[0].split("\t")
    assert len(splice) == 24 and splice[:7] == ["chr1", "4", "5", "chr2", "9", "10", "n"]
    junctions = spark.createDataFrame([("chr1", 10, 20, "G", "t", 1, 2, 6)], "target string, pos1 bigint, pos2 bigint, gene string, tid string, exon1 int, exon2 int, depth int")
    assert lines(T.junction_bed(junctions)) == ["chr1\t9\t20\tG.t.E1.E2\t6\t+\t9\t20\t0\t2\t1,1\t0,10"]
    mapped = spark.createDataFrame([("k1", "G", "t", 0.5)], "query string, gene string, tid string, coverage double")
    assert lines(T.mapping_lines(mapped)) == ["k1\tG\tt\t0.500"]
    block = "array<struct<ts: bigint, te: bigint, qs: bigint, qe: bigint>>"
    segments = spark.createDataFrame([("k1", 60, "chr1", "-", 11, 90, [(11, 40, 60, 31), (61, 90, 30, 1)]), ("k2", 60, "chr1", "+", 1, 60, [(1, 60, 1, 60)]), ("k2", 60, "chr2", "+", 1, 60, [(1, 60, 1, 60)])], f"query string, query_len int, target string, strand string, tstart bigint, tend bigint, blocks {block}")
    assert lines(T.single_alignments_bed(segments)) == ["chr1\t10\t90\tk1\t0\t-\t10\t90\t0\t2\t30,30\t0,50"]
    assert lines(T.fasta_lines(mapped, F.col("query"), F.lit("ACGT"))) == [">k1\nACGT"]
