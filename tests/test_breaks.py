"""What belongs to breaks: transcripts, rescued ends, splice sites, gates, and equal events of one contig."""

from junctura import schemas
from junctura.functions import cigar as C
from junctura.operators import adjacency as A
from junctura.operators import exons as E
from junctura.operators import fusion as U
from junctura.operators import rescue as H
from junctura.operators import segments as S
from junctura.operators import splice as P
from junctura.plans import fusion, splice
from pyspark.sql import functions as F

BLOCK = "array<struct<ts: bigint, te: bigint, qs: bigint, qe: bigint>>"
SEGMENT = f"seg_id bigint, query string, target string, strand string, qstart bigint, qend bigint, tstart bigint, tend bigint, blocks {BLOCK}"
TRANSCRIPTS = [
    ("ta", "A", "chr1", "+", True, 120, 380, [(101, 200), (301, 400)]),
    ("tl", "A", "chr1", "+", False, None, None, [(101, 200), (301, 400), (501, 900)]),
    ("tb", "B", "chr2", "+", True, 1020, 1290, [(1001, 1100), (1201, 1300)]),
    ("tc", "C", "chr2", "-", True, 5080, 5020, [(5001, 5100)]),
]


def test_transcript_at_a_break_by_each_key(spark):
    codes = "array<array<struct<exon: int, code: string>>>"
    row = lambda key, tid, coding, cds, exons, code: (key, tid, "G", "+", coding, *cds, exons, code, "L", [150])
    two, three = [(101, 200), (301, 400)], [(101, 200), (301, 400), (501, 600)]
    one, end = [[(0, "==")], [(1, "<=")]], [[(0, "==")], [(1, "<>")]]
    cds, utr = (110, 390), (160, 390)
    rows = [
        row(1, "z", False, (None, None), two, one), row(1, "a", True, cds, three, end),  # bound
        row(2, "z", True, cds, two, one), row(2, "a", False, (None, None), two, one),  # coding
        row(3, "z", True, cds, two, one), row(3, "a", True, utr, two, one),  # UTR
        row(4, "z", True, cds, two, one), row(4, "a", True, cds, two, [[(0, "=="), (1, "==")], [(1, "<=")]]),  # single
        row(5, "z", True, cds, two, [[(0, "==")], [(1, "==")]]), row(5, "a", True, cds, two, one),  # exact
        row(6, "z", True, cds, three, one), row(6, "a", True, cds, two, one),  # exons
        row(7, "z", True, cds, [(101, 200), (301, 500)], one), row(7, "a", True, cds, two, one),  # length
        row(8, "b", True, cds, two, one), row(8, "a", True, cds, two, one),  # id
    ]
    kind = f"seg_id bigint, tid string, gene string, tx_strand string, coding boolean, cds_start bigint, cds_end bigint, exons array<struct<start: bigint, end: bigint>>, codes {codes}, orient string, breaks array<bigint>"
    mapped = spark.createDataFrame(rows, kind)
    assert {r.seg_id: r.tid for r in E.best_at_break(mapped).collect()} == {**dict.fromkeys(range(1, 8), "z"), 8: "a"}
    asked = mapped.withColumn("want_gene", F.when(F.col("seg_id") == 8, "H"))
    assert {r.seg_id for r in E.best_at_break(asked).collect()} == set(range(1, 8))


def test_fusion_of_genome_segments(spark):
    tx = spark.createDataFrame(TRANSCRIPTS, schemas.TRANSCRIPTS)
    rows = [
        (1, "k1", "chr1", "+", 1, 160, 141, 400, [(141, 200, 1, 60), (301, 400, 61, 160)]), (2, "k1", "chr2", "+", 161, 220, 1001, 1060, [(1001, 1060, 161, 220)]),
        (3, "k2", "chr1", "+", 1, 160, 141, 400, [(141, 200, 1, 60), (301, 400, 61, 160)]), (4, "k2", "chr2", "-", 161, 220, 1041, 1100, [(1041, 1100, 220, 161)]),
        (5, "k3", "chr1", "+", 1, 160, 141, 400, [(141, 200, 1, 60), (301, 400, 61, 160)]), (6, "k3", "chr9", "+", 161, 220, 1, 60, [(1, 60, 161, 220)]),
    ]
    contigs = spark.createDataFrame([(k, "ACGTTGCAGT" * 22) for k in ("k1", "k2", "k3")], "name string, seq string")
    found = {r["query"]: r for r in fusion.events(spark.createDataFrame(rows, SEGMENT), tx, contigs, on_genome=True).collect()}
    k = found["k1"]
    assert (k["event"], k["tid1"], k["gene1"], k["gene2"], k["break1"], k["break2"], k["exon1"], k["exon2"], k["bound1"], k["bound2"], k["upstream"], k["reason"]) == ("fusion", "ta", "A", "B", 400, 1001, 2, 1, True, True, 1, None)
    assert k["tx_break1"] == 200 and k["tx_break2"] == 1 and found["k2"]["reason"] == "not_sense" and "k3" not in found
    other = U.mapping_states(spark.createDataFrame([("k1", "A", True), ("k2", "A", True), ("k2", "B", True)], "query string, gene string, whole boolean"))
    assert {r["query"] for r in fusion.events(spark.createDataFrame(rows, SEGMENT), tx, contigs, on_genome=True, external=other).collect()} == {"k2"}


def test_unaligned_ends_are_found_in_their_transcript(spark):
    seq = "ACGGTCATTGCAGGCTTAACCGATATCGGATCCTTAGCAACTGGTACCAT"
    tx = spark.createDataFrame([("ta", "chr1", "+", [(101, 120), (201, 230)], seq), ("tc", "chr2", "-", [(501, 550)], seq)], "tid string, chrom string, strand string, exons array<struct<start: bigint, end: bigint>>, seq string")
    contigs = spark.createDataFrame([("k1", "T" * 30 + seq[10:30]), ("k2", seq[5:25] + "G" * 30), ("k3", "A" * 40 + "C" * 10), ("k4", "T" * 30 + seq[10:30]), ("k5", "T" * 30 + seq[10:30])], "name string, seq string")
    rows = [(1, "k1", "chr1", "+", 1, 30, 1, 30, [(1, 30, 1, 30)]), (2, "k2", "chr2", "+", 21, 50, 1, 30, [(1, 30, 21, 50)]), (3, "k3", "chr1", "+", 41, 50, 1, 10, [(1, 10, 41, 50)]), (4, "k4", "chr1", "+", 1, 30, 1, 30, [(1, 30, 1, 30)]), (5, "k5", "chr1", "+", 1, 30, 1, 30, [(1, 30, 1, 30)]), (6, "k5", "chr1", "+", 1, 30, 1, 30, [(1, 30, 1, 30)])]
    segments = spark.createDataFrame(rows, SEGMENT)
    external = spark.createDataFrame([("k4", "full"), ("k1", "partial")], "query string, state string")
    ends = H.unaligned_ends(segments, contigs, external)
    assert sorted((r["query"], r.side, r.qstart, r.qend) for r in ends.collect()) == [("k1", "end", 31, 50), ("k2", "start", 1, 20)]
    best = spark.createDataFrame([(1, "ta"), (2, "tc")], "seg_id bigint, tid string")
    new = {r["query"]: tuple(r)[3:] for r in H.rescued(ends.join(best, "seg_id"), tx).collect()}
    assert new == {"k1": ("chr1", "+", 31, 50, 111, 210), "k2": ("chr2", "-", 1, 20, 526, 545)}
    on_tx = {r["query"]: tuple(r)[3:] for r in H.rescued(ends.join(best, "seg_id"), tx, on_genome=False).collect()}
    assert on_tx == {"k1": ("ta", "+", 31, 50, 11, 30), "k2": ("tc", "+", 1, 20, 6, 25)}
    pairs = fusion.with_rescued(segments, contigs, tx, best, external)
    assert sorted((r["query"], r.seg_id, r.qstart) for r in pairs.collect()) == [("k1", -3, 31), ("k1", 1, 1), ("k2", -4, 1), ("k2", 2, 21)]
    twice = tx.withColumn("seq", F.concat("seq", "seq"))
    assert H.rescued(ends.join(best, "seg_id"), twice).isEmpty()


def test_sites_of_skipped_exons_and_novel_sites(spark):
    genome = spark.createDataFrame([("chr1", 0, "ACGTACGTAC"), ("chr1", 1, "GTTTACGGAA"), ("chr1", 2, "CCAGTTACGT"), ("chr1", 3, "AAAACCCCGG")], "name string, chunk_no bigint, seq string")
    exons = [(1, 5), (12, 15), (23, 26), (33, 36)]
    rows = [("e1", "skipped_exon", "chr1", "+", exons, 1, 3), ("e2", "skipped_exon", "chr1", "-", exons, 1, 4), ("e3", "novel_donor", "chr1", "+", exons, 2, 3), ("e4", "novel_acceptor", "chr1", "-", exons, 2, 3), ("e5", "novel_intron", "chr1", "+", exons, 1, 2), ("e6", "skipped_exon", "chr1", "+", exons, 1, 2)]
    df = spark.createDataFrame(rows, "event_id string, event string, chrom string, strand string, exons array<struct<start: bigint, end: bigint>>, number1 int, number2 int")
    got = {r.event_id: (r.sites and [tuple(x) for x in r.sites], r.site_bases) for r in P.canonical_sites(df, genome, 10).collect()}
    whole = "ACGTACGTACGTTTACGGAACCAGTTACGTAAAACCCCGG"
    at = lambda *p: [(i, whole[i - 1]) for i in p]
    assert got["e1"] == (at(10, 11, 16, 17), "CGCG") and got["e2"] == (at(10, 11, 16, 17), "CGCG")
    assert got["e3"] == (at(16, 17, 21, 22), "CGCC") and got["e4"] == (at(16, 17, 21, 22), "CGGG")
    assert got["e5"] == got["e6"] == (None, None)


def test_retained_intron_motifs(spark):
    rows = [("+", "GTAAAG", "GTAAAG"), ("-", "GTAAAG", "GTAAAG"), ("+", "GCAAAG", "GTAAAG"), ("-", "GTAAAG", "GTAAAC"), ("+", "CCAAAG", "GTAAAG"), ("+", "GCAACG", "GTAAAG")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, strand string, contig string, genome string")
    found = df.select("i", P.retained_intron_motif(F.lit("chr1"), F.lit(100), F.lit(107), F.col("contig"), F.col("genome"), F.col("strand")).alias("m")).collect()
    got = {r.i: r.m and [tuple(x) for x in r.m] for r in found}
    assert got[0] == [("GT", None), ("AG", None)] and got[1] == [("AC", None), ("CT", None)]
    assert got[2] == [("GC", "chr1:102T>C"), ("AG", None)] and got[3] == [("AC", None), ("CT", "chr1:106C>G")] and got[4] is got[5] is None


def test_equal_events_at_two_breaks_of_a_contig_go(spark):
    base = ("del", "1", 5, "L", "1", 90, "R")
    rows = [("a", *base, 10, 11), ("a", *base, 50, 51), ("b", *base, 10, 11), ("b", *base, 10, 11), ("c", *base, 10, 11), ("c", "del", "1", 6, "L", "1", 90, "R", 20, 21), ("c", *base, 30, 31)]
    df = spark.createDataFrame([(*r, None) for r in rows], "query string, rearrangement string, chrom1 string, break1 bigint, orient1 string, chrom2 string, break2 bigint, orient2 string, cb1 bigint, cb2 bigint, homol_seq string")
    assert sorted((r["query"], r.cb1) for r in A.sane(df).collect()) == [("b", 10), ("c", 10), ("c", 20), ("c", 30)]


def test_gates_of_indels(spark):
    parts = lambda text: [(op, int(n)) for n, op in __import__("re").findall(r"(\d+)([MSHIDN])", text)]
    rows = [(1, "k", "chr1", "+", 101, parts("40M6D60M")), (2, "k", "chr1", "+", 101, parts("40M2D60M")), (3, "k", "chr1", "+", 101, parts("90M6D10M")), (4, "k", "chr1", "-", 101, parts("10M6D90M"))]
    df = spark.createDataFrame(rows, "seg_id bigint, query string, target string, strand string, pos bigint, cigar array<struct<op: string, len: int>>").withColumn("blocks", C.blocks(F.col("cigar"), F.col("pos"), F.col("strand")))
    contigs = spark.createDataFrame([("k", "ACGTTGCAGA" * 10)], "name string, seq string")
    ids = lambda **how: sorted(r.seg_id for r in S.gapped_indels(df, contigs, **how).collect())
    assert ids() == [1, 2, 3, 4] and ids(least_size=3) == [1, 3, 4] and ids(least_flank=20) == [1, 2] and ids(least_size=3, least_flank=20) == [1]


def test_annotations_together(spark):
    row = "row bigint, feature string, tid string, chrom string, start bigint, end bigint"
    one = spark.createDataFrame([(1, "exon", "t", "1", 1, 9), (2, "exon", "t", "1", 20, 29), (3, "CDS", "t", "1", 3, 5)], row)
    two = spark.createDataFrame([(1, "exon", "u", "1", 1, 9), (2, "exon", "u", "1", 20, 31), (3, "exon", "u", "1", 40, 50)], row)
    got = {(r.start, r.end): r.sources for r in splice.known_junctions({"b": one, "a": two}).collect()}
    assert got == {(9, 20): ["a", "b"], (31, 40): ["a"]}
    genes = spark.createDataFrame([("A",), ("Z",), ("Z",)], "gene string")
    assert [r.gene for r in E.unannotated_genes(genes, spark.createDataFrame(TRANSCRIPTS, schemas.TRANSCRIPTS)).collect()] == ["Z"]


def test_sub_sequences_of_the_best_contig(spark):
    events = spark.createDataFrame([(1, "fusion", "a", 1, 10, 11), (1, "fusion", "b", 2, 30, 29), (2, "skipped_exon", "a", 1, 10, 11), (3, "repeat_expansion", "a", 1, 10, 11), (4, "dup", "a", 2, 10, 11), (4, "dup", "c", 1, 10, 11)], "event_id bigint, event string, query string, nth int, cb1 bigint, cb2 bigint")
    a, b, c = "ACGT" * 10, "GGCA" * 15, "TTAC" * 10
    contigs = spark.createDataFrame([("a", a), ("b", b), ("c", c)], "name string, seq string")
    got = {(r.event_id, r.piece): (r["query"], r.seq) for r in U.sub_sequences(events, contigs).collect()}
    assert got == {(1, 0): ("b", b[:29]), (1, 1): ("b", b[29:]), (4, 0): ("c", c[:10]), (4, 1): ("c", c[10:])}
    short = {(r.event_id, r.piece): r.seq for r in U.sub_sequences(events, contigs, each_side=5).collect()}
    assert short[(4, 0)] == c[5:10] and short[(4, 1)] == c[10:15]
    hits = spark.createDataFrame([(1, 0, "chr1", 29, 0), (1, 0, "chr2", 29, 0), (4, 1, "chr1", 30, 0), (4, 1, "chr2", 30, 0)], "event_id bigint, piece int, target string, matched int, nm int")
    pieces = U.sub_sequences(events, contigs).drop("query").join(hits, ["event_id", "piece"])
    found = events.select("event_id").distinct()
    assert sorted(r.event_id for r in fusion.unique_events(found, pieces).collect()) == [2, 3, 4]


def test_probes_that_speak_against_events(spark):
    events = spark.createDataFrame([(1, "fusion", None, "A", "B"), (2, "fusion", None, "A", "B"), (3, "fusion", None, "A", "B"), (4, "del", 6, "A", "A"), (5, "ins", 4, "A", "A"), (6, "dup", 4, "A", "A")], "event_id bigint, event string, size int, gene1 string, gene2 string")
    probes = [(1, "chr1", 100, 199, 98, 100, 1, []), (2, "chr5", 100, 199, 95, 100, 5, []), (3, "chr1", 100, 199, 95, 100, 5, []), (4, "chr1", 100, 199, 94, 100, 6, [6]), (5, "chr1", 100, 199, 96, 100, 4, [3]), (6, "chr1", 100, 199, 98, 100, 0, [])]
    found = spark.createDataFrame(probes, "event_id bigint, target string, tstart bigint, tend bigint, matched int, length int, nm int, indel_sizes array<int>")
    genes = spark.createDataFrame([("A", "chr1", 230, 400), ("B", "chr2", 1, 50)], "gene string, chrom string, start bigint, end bigint")
    assert sorted(r.event_id for r in U.explained_probes(events, found, genes).collect()) == [1, 2, 5]


def test_read_through_of_one_alignment(spark):
    codes = "array<array<struct<exon: int, code: string>>>"
    rows = [
        (1, "k", "A", "ta", [[(0, "==")], [(1, "==")], None, None], [(1, 50, 1, 50), (101, 150, 51, 100), (501, 550, 101, 150), (601, 650, 151, 200)]),
        (1, "k", "B", "tb", [None, None, [(0, "==")], [(1, "==")]], [(1, 50, 1, 50), (101, 150, 51, 100), (501, 550, 101, 150), (601, 650, 151, 200)]),
        (2, "m", "A", "ta", [[(0, "==")], [(1, "==")]], [(1, 50, 1, 50), (101, 150, 51, 100)]),
    ]
    mapped = spark.createDataFrame(rows, f"seg_id bigint, query string, gene string, tid string, codes {codes}, blocks {BLOCK}")
    assert [tuple(r) for r in U.read_through_alignments(mapped).collect()] == [(1, "k", "A", "B", 150, 501)]


def test_rows_of_same_event_twice_hold_no_copies_of_their_columns(spark):
    """What is shuffled and sorted are the columns alone; an edge of a contig is no neighbour, not even of an event of nulls."""
    from junctura.operators import adjacency as A

    rows = [("q", *["x"] * 7, 1, 9), ("q", *["x"] * 7, 2, 9), ("q", *["x"] * 7, 2, 9), ("r", *["x"] * 7, 1, 9), ("r", *["y"] + ["x"] * 6, 2, 9), ("s", *[None] * 7, 1, 9), ("t", *[None] * 7, 1, 9), ("t", *[None] * 7, None, 9)]
    got = A.same_event_twice(spark.createDataFrame(rows, "query string, " + ", ".join(f"{c} string" for c in A.KEY) + ", cb1 int, cb2 int"))
    assert "struct(" not in got._jdf.queryExecution().optimizedPlan().toString() and "named_struct" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((x.query, x.cb1 or 0, x.twice) for x in got.collect()) == [("q", 1, True), ("q", 2, False), ("q", 2, True), ("r", 1, False), ("r", 2, False), ("s", 1, False), ("t", 0, True), ("t", 1, True)]
