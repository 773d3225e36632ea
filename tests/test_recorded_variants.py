"""Variants and their records from the adjacencies of thirteen contigs whose records are known, and from alignments to records."""

from pyspark.sql import functions as F

from junctura.functions import cigar as C
from junctura.operators import variants as V
from junctura.plans import genome, refilter
from junctura.sinks import tables, vcf

SHAPE = (
    "adj_id bigint, rearrangement string, chrom1 string, break1 bigint, orient1 string, chrom2 string, break2 bigint, orient2 string, size bigint, contig string, cb1 bigint, cb2 bigint, homol_seq string, "
    "novel_seq string, repeat_seq string, repeat_num string, repeat_change string, align_type string, span1_start bigint, span1_end bigint, span2_start bigint, span2_end bigint, ref1 string, ref2 string"
)
NONE = (None, None, None)
# Breaks, sequences, contig breaks and the kind of alignment as recorded; spans end at the breaks.
ADJACENCIES = [
    (26, "trl", "chr8", 128748330, "R", "chrX", 96459713, "L", None, "22942802", 543, 544, None, None, *NONE, "split", 128748330, 128748900, 96459100, 96459713, "C", "T"),
    (29, "trl", "chr8", 128753448, "L", "chrX", 96459693, "R", None, "22078527", 808, 807, "AG", None, *NONE, "split", 128752700, 128753448, 96459693, 96460400, "T", "C"),
    (27, "trl", "chr8", 128748330, "R", "chrX", 96860371, "L", None, "22194912", 3760, 3761, None, None, *NONE, "split", 128748330, 128749000, 96859000, 96860371, "C", "T"),
    (28, "trl", "chr8", 128753447, "L", "chrX", 96860346, "R", None, "J23188714", 1680, 1681, None, None, *NONE, "split", 128752700, 128753447, 96860346, 96862000, "T", "C"),
    (21, "inv", "chr8", 141141451, "L", "chr8", 141142311, "L", 861, "J19570308", 77, 75, "CTC", None, *NONE, "split", 141141375, 141141451, 141142235, 141142311, "G", "A"),
    (20, "inv", "chr8", 141141449, "R", "chr8", 141142309, "R", 861, "J19637208", 77, 75, "GAG", None, *NONE, "split", 141141449, 141141525, 141142309, 141142380, "A", "G"),
    (22, "trl", "chr15", 43914046, "R", "chrX", 132777895, "R", None, "2078529", 6046, 6090, None, "AACAAGAGGGAAACTCTATCTCAAAAAAAAAAAAACAACAAAA", *NONE, "split", 43914046, 43920000, 132777895, 132778144, "A", "G"),
    (23, "trl", "chr15", 43914063, "L", "chrX", 132778144, "L", None, "2078529", 6341, 6351, None, "CAACCGGTT", *NONE, "split", 43908000, 43914063, 132777895, 132778144, "C", "G"),
    (24, "trl", "chr16", 10972522, "L", "chrX", 41548790, "R", None, "6412", 106, 106, "G", None, *NONE, "gapped", None, None, None, None, "C", "C"),
    (25, "trl", "chr16", 10972530, "R", "chrX", 41548790, "L", None, "6434", 121, 125, None, "TGA", *NONE, "gapped", None, None, None, None, "A", "C"),
    (6, "del", "chr8", 41555972, "L", "chr8", 41559597, "R", 3624, "J19536665", 126, 125, "CT", None, *NONE, "split", None, None, None, None, "T", "A"),
    (8, "dup", "chr1", 208440810, "L", "chr1", 208440847, "R", 36, "1047129", 115, 179, None, "CAG" * 12, "CAG", "12", "9>21", "gapped", None, None, None, None, "C", "A"),
    (15, "dup", "chr8", 84140473, "R", "chr8", 84154044, "L", 13572, "J19639045", 81, 75, "ATGTGTG", None, *NONE, "split", None, None, None, None, "A", "T"),
]
SUPPORT = [
    ("J19639045", 75, 81, 38), ("22942802", 543, 544, 12), ("J19570308", 75, 77, 39), ("J23188714", 1680, 1681, 41), ("6412", 106, 106, 47), ("22194912", 3760, 3761, 19), ("6434", 121, 125, 45), ("2078529", 6046, 6090, 15),
    ("2078529", 6341, 6351, 27), ("J19536665", 125, 126, 60), ("J19637208", 75, 77, 42), ("1047129", 115, 179, 5), ("22078527", 807, 808, 18),
]
# The records of these adjacencies.
RECORDS = """1 208440810 8 C <DUP:TANDEM> SVTYPE=DUP;END=208440846;SVLEN=36;BKPTID=1047129;REPEAT_SEQ=CAG;REPEAT_NUM=12;REPEAT_NUM_CHANGE=9>21;SPANNING_READS=5;FLANKING_PAIRS=0
15 43914046 22-23 A <INS> SVTYPE=INS;END=43914046;SVLEN=250;CIPOS=0,17;BKPTID=2078529;SPANNING_READS=15;FLANKING_PAIRS=0
16 10972521 24a C C[X:41548791[ SVTYPE=BND;EVENTTYPE=TRL;PARID=25a;MATEID=24b;CIPOS=0,1;HOMLEN=1;HOMSEQ=G;BKPTID=6412;EVENT=TRL24-25;SPANNING_READS=47;FLANKING_PAIRS=0
16 10972530 25a A ]X:41548790]TGAA SVTYPE=BND;EVENTTYPE=TRL;PARID=24a;MATEID=25b;BKPTID=6434;EVENT=TRL24-25;SPANNING_READS=45;FLANKING_PAIRS=0
8 141141451 21-20 G <INV> SVTYPE=INV;END=141142312;SVLEN=861;CIPOS=0,3;HOMLEN=3;HOMSEQ=CTC;BKPTID=J19570308,J19637208;SPANNING_READS=39;FLANKING_PAIRS=0
8 41555972 6 T <DEL> SVTYPE=DEL;END=41559596;SVLEN=-3624;CIPOS=0,2;HOMLEN=2;HOMSEQ=CT;BKPTID=J19536665;SPANNING_READS=60;FLANKING_PAIRS=0
8 84140473 15 A <DUP:TANDEM> SVTYPE=DUP;END=84154045;SVLEN=13572;CIPOS=0,7;HOMLEN=7;HOMSEQ=ATGTGTG;BKPTID=J19639045;SPANNING_READS=38;FLANKING_PAIRS=0
X 41548790 24b C ]16:10972522]C SVTYPE=BND;EVENTTYPE=TRL;PARID=25b;MATEID=24a;CIPOS=0,1;HOMLEN=1;HOMSEQ=G;BKPTID=6412;EVENT=TRL24-25;SPANNING_READS=47;FLANKING_PAIRS=0
X 41548790 25b C CTGA[16:10972530[ SVTYPE=BND;EVENTTYPE=TRL;PARID=24b;MATEID=25a;BKPTID=6434;EVENT=TRL24-25;SPANNING_READS=45;FLANKING_PAIRS=0
X 96459693 26-29 C <INS> SVTYPE=INS;END=96459693;SVLEN=5119;CIPOS=0,20;BKPTID=22078527,22942802;SPANNING_READS=12;FLANKING_PAIRS=0
X 96860346 27-28 C <INS> SVTYPE=INS;END=96860346;SVLEN=5118;CIPOS=0,25;BKPTID=22194912,J23188714;SPANNING_READS=19;FLANKING_PAIRS=0"""


def test_recorded_adjacencies_make_the_recorded_variants(spark):
    events = spark.createDataFrame(ADJACENCIES, SHAPE).withColumns({"dubious": F.lit(False), "strand1": F.lit("+"), "strand2": F.lit("+"), "overlaps": F.col("cb1") >= F.col("cb2"), "contigs": F.col("contig"), "ref_seq": F.lit(None).cast("string")})
    support = spark.createDataFrame([(*r, 0) for r in SUPPORT], "contig string, span1 bigint, span2 bigint, spanning int, flanking int")
    events = refilter.support_of(events.withColumns({"cb1": F.col("cb1").cast("string"), "cb2": F.col("cb2").cast("string")}), support).withColumns({c: F.col(c).cast("bigint") for c in ("cb1", "cb2")})
    assert refilter.passed(events).count() == 13
    found = V.assemble(events).cache()
    got = sorted((r["chrom"], str(r["pos"]), r["id"], r["ref"], r["alt"], sorted(r["info"].split(";"))) for r in vcf.variant_records(found, events).collect())
    want = [line.split(" ") for line in RECORDS.split("\n")]
    assert got == sorted((*w[:5], sorted(w[5].split(";"))) for w in want)  # the order of INFO says nothing
    called = {r["adj_id"]: (r["rearrangement"], r["size"]) for r in V.as_insertions(events, found).collect()}
    assert [called[i] for i in (26, 29, 27, 28, 22, 23)] == [("ins", 5119)] * 2 + [("ins", 5118)] * 2 + [("ins", 250)] * 2 and called[24] == ("trl", None) and called[21] == ("inv", 861)
    lines = {r["value"].split("\t")[6]: r["value"].split("\t")[:14] for r in tables.genome_bedpe(V.as_insertions(events, found)).collect()}
    assert lines["26"] == ["chr8", "128748329", "128748330", "chrX", "96459712", "96459713", "26", ".", "+", "+", "R", "L", "ins", "5119"] and lines["24"][12:] == ["trl", "NA"]


def test_a_contig_makes_one_imprecise_insertion_and_none_with_itself(spark):
    row = lambda i, contig, kind="trl", b1=500, o1="R", c2="chrX", b2=1000, o2="L", align="split": (i, kind, "chr8", b1, o1, c2, b2, o2, None, contig, 1, 2, None, None, *NONE, align, 1, 2, b2, b2, "A", "A")
    rows = [
        row(1, "a"), row(2, "a", b1=900, o1="L", b2=1010, o2="R"),  # one contig
        row(3, "b", c2="chr9", b2=50), row(4, "c", b1=7000, o1="L", c2="chr9", b2=60, o2="R"), row(5, "c", b1=7000, o1="L", c2="chr9", b2=70, o2="R"), row(6, "d", b1=7, c2="chr9", b2=55),  # c is used up by b
        row(7, "e", c2="chr7", b2=50, align="gapped"), row(8, "f", b1=7000, o1="L", c2="chr7", b2=60, o2="R"),  # only split ones
    ]
    events = spark.createDataFrame(rows, SHAPE).withColumn("dubious", F.lit(False))
    got = {r["variant_id"]: (r["event"], r["pos"], r["pos2"], r["insertion_size"]) for r in V.assemble(events).collect()}
    assert got["3-4"] == ("INS", 50, 60, 6501) and {k for k in got if "-" in k and got[k][0] == "INS"} == {"3-4"}
    assert V.assemble(events.limit(0)).count() == 0


def test_long_novel_sequences_are_places_of_the_contig(spark):
    row = (9, "trl", "chr2", 500, "L", "chr5", 900, "R", None, "k", 30, 91, None, "ACGT" * 15, *NONE, "split", 1, 500, 900, 1000, "A", "G")
    events = spark.createDataFrame([row], SHAPE).withColumns({"strand1": F.lit("+"), "strand2": F.lit("-"), "overlaps": F.lit(False), "contigs": F.lit("k"), "spanning": F.lit(3), "flanking": F.lit(1)})
    assert [r["alt"] for r in vcf.breakends(events).orderBy("id").collect()] == ["A[<k>:31[", "]<k>:90]G"]
    assert [r["alt"] for r in vcf.breakends(events, most_novel=60).orderBy("id").collect()] == ["A" + "ACGT" * 15 + "[5:900[", "]2:500]" + "ACGT" * 15 + "G"]


def test_from_alignments_to_records(spark):
    rows = [(1, "c1", 0, "chr1", 101, 60, "50M50S"), (2, "c1", 0, "chr1", 501, 60, "50S50M"), (3, "c2", 0, "chr2", 11, 60, "40M10D40M"), (4, "c3", 0, "chr1", 91, 60, "60M40S"), (5, "c3", 0, "chr1", 501, 60, "60S40M"), (6, "c4", 0, "chr1", 101, 60, "50M50S"), (7, "c4", 0, "chr2", 301, 60, "50S50M")]
    seq = "ACGTTGCA" * 12 + "ACGT"
    df = spark.createDataFrame([(*r, "ACGTTGCA" * 10 if r[1] == "c2" else seq, 10 if r[1] == "c2" else 0) for r in rows], "seq_no bigint, query string, flag int, target string, pos bigint, mapq int, c string, seq string, nm int").withColumn("cigar", C.parse_cigar(F.col("c")))
    contigs = spark.createDataFrame([(k, "ACGTTGCA" * 10 if k == "c2" else seq) for k in ("c1", "c2", "c3", "c4")], "name string, seq string")
    reads = spark.createDataFrame([(i, f"r{i}", c, 1 + i, 90, "+", True) for c in ("c1", "c2", "c3", "c4") for i in range(5)], "seq_no bigint, name string, contig string, rstart bigint, rend bigint, strand string, whole boolean")
    fragments = spark.createDataFrame([("c1", 40, 70)], "contig string, inner1 bigint, inner2 bigint")
    found = genome.supported_events(genome.events(df, contigs), reads.where("rstart < 40"), fragments)
    adjacencies = genome.merged(found).cache()
    by = {(r["rearrangement"], r["chrom1"], r["chrom2"]): r for r in adjacencies.collect()}
    one = by["del", "chr1", "chr1"]
    assert (one["contigs"], one["cb1s"], one["cb2s"], one["spanning"], one["flanking"], one["size"]) == ("c1,c3", "50,60", "51,61", 10, 1, 350)
    assert (one["span1_start"], one["span1_end"], one["span2_start"], one["span2_end"]) == (101, 150, 501, 550) and by["del", "chr2", "chr2"]["span1_start"] is None
    bases = spark.createDataFrame([("chr1", 1, "A" * 149 + "G" + "A" * 400), ("chr2", 1, "C" * 45 + "ttgtt" + "ACGTACGTAC" + "C" * 300)], "chrom string, start bigint, seq string")
    got = {(r["chrom"], r["pos"]): (r["ref"], r["alt"]) for r in genome.records(adjacencies, genome.variants(adjacencies), bases).collect()}
    assert got["1", 150] in {("G", "<DEL>"), ("G", "G[2:301[")} and got["2", 50] == ("TACGTACGTAC", "T") and got["2", 301] == ("C", "]1:150]C") and len(got) == 3


def test_the_whole_analysis(spark):
    seq = "ACGTTGCAGATTACAG" * 7
    seq = seq[:100]
    row = lambda i, q, t, pos, c: (i, q, 0, t, pos, 60, c, seq, 0)
    rows = [
        row(1, "c1", "chr1", 101, "50M50S"), row(2, "c1", "chr1", 501, "50S50M"),  # a deletion
        row(3, "c2", "chr3", 5001, "50M50S"), row(4, "c2", "chr4", 701, "50S50M"),  # a break in a bad region
        row(5, "c3", "chr5", 101, "50M50S"), row(6, "c3", "chr5", 901, "50S50M"),  # at a centromere
        row(7, "c4", "chr6", 101, "50M50S"), row(8, "c4", "chr6", 901, "50S50M"),  # no reads
        row(9, "c5", "chr7", 101, "50M50S"), row(10, "c5", "chr7", 901, "50S50M"),  # its probe aligns end to end
    ]
    df = spark.createDataFrame(rows, "seq_no bigint, query string, flag int, target string, pos bigint, mapq int, c string, seq string, nm int").withColumn("cigar", C.parse_cigar(F.col("c")))
    contigs = spark.createDataFrame([(f"c{k}", seq) for k in range(1, 6)], "name string, seq string")
    reads = spark.createDataFrame([(i, f"{c}r{i}", c, 1 + i, 90, "+", True) for c in ("c1", "c2", "c3", "c5") for i in range(5)], "seq_no bigint, name string, contig string, rstart bigint, rend bigint, strand string, whole boolean")
    fragments = spark.createDataFrame([("c1", 40, 70)], "contig string, inner1 bigint, inner2 bigint")
    bases = spark.createDataFrame([(f"chr{n}", 1, "ACGT" * 400) for n in range(1, 8)], "chrom string, start bigint, seq string")
    region = lambda *r: spark.createDataFrame([r], "chrom string, start bigint, stop bigint")
    give = {"reads": reads, "fragments": fragments, "bad": region("chr3", 5040, 5060), "centromeres": region("chr5", 1, 120)}
    found = genome.analyse(df, contigs, bases, **give)
    first = {r["contig"]: r for r in found.adjacencies.collect()}
    assert set(first) == {"c1", "c4", "c5"} and first["c1"]["probe"] == seq[25:75] and (first["c1"]["cb1"], first["c1"]["cb2"]) == ("50", "51")
    assert sorted((r["chrom"], r["pos"], r["alt"]) for r in found.records.collect()) == [("1", 150, "<DEL>"), ("6", 150, "<DEL>"), ("7", 150, "<DEL>")]
    kept = {r["contig"]: (r["spanning"], r["flanking"]) for r in found.supported_adjacencies.collect()}
    assert kept == {"c1": (5, 1), "c5": (5, 0)} and found.supported_variants.count() == 2
    assert {r["info"].split("SPANNING")[1] for r in found.supported_records.collect()} == {"_READS=5;FLANKING_PAIRS=1", "_READS=5;FLANKING_PAIRS=0"}
    again = spark.createDataFrame([(f"c5.{first['c5']['adj_id']}", [("M", 50)], False), (f"c1.{first['c1']['adj_id']}", [("M", 25), ("S", 25)], False)], "query string, cigar array<struct<op: string, len: int>>, unmapped boolean")
    screened = genome.analyse(df, contigs, bases, realignments=again, **{k: give[k] for k in ("bad", "centromeres")})
    assert sorted(r["contig"] for r in screened.adjacencies.collect()) == ["c1", "c4"] and screened.supported_records is None
    assert len(tables.genome_bedpe(screened.adjacencies).first()["value"].split("\t")) == 27
    assert genome.analyse(df.limit(0), contigs, bases, **give).supported_records.count() == 0
