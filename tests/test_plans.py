"""Whole analyses on small made-up inputs."""

from pyspark.sql import functions as F

from junctura import schemas
from junctura.functions import cigar as C
from junctura.plans import fusion, links, refilter, rescue
from junctura.sinks import vcf
from junctura.sources import text

TRANSCRIPTS = [
    ("ta", "A", "chr1", "+", True, 120, 380, [(101, 200), (301, 400)]),
    ("tb", "B", "chr2", "+", True, 1020, 1290, [(1001, 1100), (1201, 1300)]),
    ("tc", "C", "chr2", "-", True, 5080, 5020, [(5001, 5100)]),
]


def test_fusion_between_exon_bounds(spark):
    tx = spark.createDataFrame(TRANSCRIPTS, schemas.TRANSCRIPTS)
    rows = [(1, "k1", "ta", "+", 1, 60, 41, 100), (2, "k1", "tb", "+", 61, 120, 101, 160), (3, "k2", "ta", "+", 1, 60, 31, 90), (4, "k2", "tb", "-", 61, 120, 101, 160), (5, "k3", "ta", "+", 1, 60, 41, 100), (6, "k3", "tb", "+", 61, 120, 101, 160)]
    segments = spark.createDataFrame(rows, "seg_id bigint, query string, target string, strand string, qstart bigint, qend bigint, tstart bigint, tend bigint")
    contigs = spark.createDataFrame([(k, "ACGTTGCA" * 15) for k in ("k1", "k2", "k3")], "name string, seq string")
    found = fusion.events(segments, tx, contigs)
    by = {r["query"]: r for r in found.collect()}
    k = by["k1"]
    assert (k["event"], k["gene1"], k["gene2"], k["break1"], k["break2"], k["exon1"], k["exon2"], k["upstream"], k["bound1"], k["bound2"], k["reason"]) == ("fusion", "A", "B", 200, 1201, 1, 2, 1, True, True, None)
    assert by["k2"]["upstream"] is None and by["k2"]["reason"] == "not_sense"
    reads = spark.createDataFrame([(i, f"r{i}", "k1" if i < 3 else "k3", 30 + i, 90 + i, "+", True) for i in range(6)], "seq_no bigint, name string, contig string, rstart bigint, rend bigint, strand string, whole boolean")
    pairs = spark.createDataFrame([("k1", 50, 60)], "contig string, inner1 bigint, inner2 bigint")
    out = fusion.report(found, reads, pairs).collect()
    assert [(r["report_id"], r["event"], r["query"], r["breaks"], r["spanning"], r["flanking"]) for r in out] == [(1, "fusion", "k1,k3", "60-61,60-61", 6, 1)]
    assert fusion.report(found, reads, pairs, least=7).isEmpty()


def test_read_through_of_neighbours(spark):
    tx = spark.createDataFrame([("ta", "A", "chr1", "+", True, 120, 380, [(101, 200), (301, 400)]), ("tb", "B", "chr1", "+", True, 1020, 1290, [(1001, 1100), (1201, 1300)])], schemas.TRANSCRIPTS)
    segments = spark.createDataFrame([(1, "k", "ta", "+", 1, 60, 41, 100), (2, "k", "tb", "+", 61, 120, 101, 160)], "seg_id bigint, query string, target string, strand string, qstart bigint, qend bigint, tstart bigint, tend bigint")
    contigs = spark.createDataFrame([("k", "ACGTTGCA" * 15)], "name string, seq string")
    assert [r["event"] for r in fusion.events(segments, tx, contigs).collect()] == ["read_through"]
    more = tx.union(spark.createDataFrame([("tm", "M", "chr1", "+", True, 510, 590, [(501, 600)])], schemas.TRANSCRIPTS))
    assert [r["event"] for r in fusion.events(segments, more, contigs).collect()] == ["fusion"]


def test_refilter(spark):
    adjacencies = spark.createDataFrame([(1, "a,b", "5,9", "6,8"), (2, "c", "3", "4"), (3, "d", "1", "2")], "adj_id bigint, contig string, cb1 string, cb2 string")
    support = spark.createDataFrame([("a", 5, 6, 1, 2), ("b", 8, 9, 3, 0), ("c", 3, 4, 1, 7), ("z", 1, 2, 9, 9)], "contig string, span1 bigint, span2 bigint, spanning int, flanking int")
    rows = refilter.support_of(adjacencies, support)
    assert {r["adj_id"]: (r["spanning"], r["flanking"]) for r in rows.collect()} == {1: (4, 2), 2: (1, 7), 3: (None, None)}
    assert [r["adj_id"] for r in refilter.passed(rows).collect()] == [1]
    variants = spark.createDataFrame([("v1", [1]), ("v2", [1, 2]), ("v3", [99]), ("v4", [3])], "variant_id string, adj_ids array<bigint>")
    kept = {r["variant_id"]: (r["spanning"], r["flanking"]) for r in refilter.variants_passed(variants, rows).collect()}
    assert kept == {"v1": (4, 2), "v3": (None, None)}
    somatic, germline = refilter.tumour_only(adjacencies, support, spark.createDataFrame([("c", 4, 3, 5, 0)], support.schema), least=1)
    assert sorted(r["adj_id"] for r in somatic.collect()) == [1] and [r["adj_id"] for r in germline.collect()] == [2]


def test_rescued_fusion(spark):
    tx = spark.createDataFrame(TRANSCRIPTS, schemas.TRANSCRIPTS)
    rows = [(f"p{i}", m, t, pos, tend, c) for i in range(4) for m, t, pos, tend, c in ((1, "ta", 41, 98 + i % 2, "58M10S"), (2, "tb", 101, 160, "10S60M"))]
    rows += [("q", 1, "ta", 1, 50, "50M"), ("q", 2, "tc", 1, 50, "50M")]
    reads = spark.createDataFrame(rows, "name string, mate int, target string, pos bigint, tend bigint, c string").withColumn("cigar", C.parse_cigar(F.col("c"))).drop("c")
    out = [tuple(r) for r in rescue.fusions(reads, tx).collect()]
    assert out == [("A", "B", 4, "chr1", 200, "L", "chr2", 1201, "R")]


def test_linked_splice_site_variants(spark):
    site = "array<struct<pos: bigint, base: string>>"
    rows = [(1, "novel_donor", "chr1", "GCAG", [(10, "T")]), (2, "skipped_exon", "chr1", "GTAG", [(20, "G"), (21, "T"), (30, "A"), (31, "G")]), (3, "novel_donor", "chr1", "GTAG", [])]
    events = spark.createDataFrame(rows, f"event_id bigint, event string, chrom string, motif string, sites {site}")
    seq = list("A" * 40)
    for p, b in ((10, "T"), (20, "G"), (21, "C"), (30, "A"), (31, "G")):
        seq[p - 1] = b
    reads = spark.createDataFrame([("chr1", [(1, 40, 1, 40)], "".join(seq))] * 3 + [("chr1", [(1, 12, 1, 12)], "A" * 12)], f"chrom string, blocks {schemas.BLOCKS}, seq string")
    by_reads = {r["event_id"]: (r["variant"], r["genome_support"]) for r in links.corroborated(events, reads=reads).collect()}
    assert by_reads == {1: (None, "3/4"), 2: ("chr1:21T>C", "3/3"), 3: (None, None)}
    calls = spark.createDataFrame([("chr1", 10, "C", "T", "7", "9"), ("chr1", 29, "CAG", "C", "2", "8"), ("chr1", 500, "A", "T", "1", "1")], "vchrom string, vpos bigint, ref string, alt string, ad string, dp string")
    by_calls = {r["event_id"]: (r["variant"], r["genome_support"]) for r in links.corroborated(events, calls=calls).collect()}
    assert by_calls == {1: (None, "7/9"), 2: ("chr1:29-31CAG>C,chr1:29-31CAG>C", "2/8,2/8"), 3: (None, None)}
    assert all(r["variant"] is None for r in links.corroborated(events).collect())


def test_calls_of_a_sample(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\nchr1\t5\t.\tA\tT\t.\t.\tK=1\tGT:AD:DP\t0/1:3,4:7\nchr1\t6\t.\tA\tT\t.\t.\tK=1\tGT\t0/1\n")
    assert [tuple(r) for r in text.calls(text.vcf(spark, str(tmp_path / "a.vcf"))).orderBy("vpos").collect()] == [("chr1", 5, "A", "T", "4", "7"), ("chr1", 6, "A", "T", None, None)]


def test_records_of_variants(spark):
    shape = "adj_id bigint, rearrangement string, chrom1 string, break1 bigint, orient1 string, chrom2 string, break2 bigint, orient2 string, size bigint, ref1 string, ref2 string, ref_seq string, novel_seq string, contigs string, spanning int, flanking int"
    rows = [
        (1, "inv", "chr1", 10, "L", "chr1", 50, "L", 41, "A", "C", None, None, "k2,k1", 5, 1), (2, "inv", "chr1", 11, "R", "chr1", 51, "R", 41, "A", "C", None, None, "k3", 3, 2),
        (3, "trl", "chr1", 7, "L", "chr2", 8, "R", None, "G", "T", None, None, "k4", 4, 0), (4, "trl", "chr1", 8, "R", "chr2", 7, "L", None, "G", "T", None, None, "k5", 4, 0),
        (5, "del", "chr3", 20, "L", "chr3", 24, "R", 3, "A", "C", "ATTT", None, "k6", 2, 0), (6, "del", "chr3", 20, "L", "chr3", 2024, "R", 2003, "A", "C", None, None, "k7", 2, 0),
        (7, "trl", "chr4", 30, "L", "chr5", 90, "R", None, "A", "T", None, None, "k8", 6, 0), (8, "trl", "chr4", 95, "R", "chr5", 91, "L", None, "A", "T", None, None, "k9", 7, 0),
    ]
    none = F.lit(None).cast("string")
    events = spark.createDataFrame(rows, shape).withColumns({"strand1": F.lit("+"), "strand2": F.lit("+"), "homol_seq": none, "overlaps": F.lit(False), "repeat_seq": none, "repeat_num": none, "repeat_change": none})
    variants = spark.createDataFrame([("1-2", "INV", "chr1", None, [1, 2]), ("3-4", "TRL", "chr1", None, [3, 4]), ("5", "DEL", "chr3", 20, [5]), ("6", "DEL", "chr3", 20, [6]), ("7-8", "INS", "chr5", 90, [7, 8])], schemas.VARIANTS)
    got = {r["id"]: (r["chrom"], r["pos"], r["ref"], r["alt"], r["info"]) for r in vcf.variant_records(variants, events).collect()}
    assert set(got) == {"1-2", "3a", "3b", "4a", "4b", "5", "6", "7-8"}
    assert got["1-2"] == ("1", 10, "A", "<INV>", "SVTYPE=INV;END=51;SVLEN=41;BKPTID=k1,k2,k3;SPANNING_READS=3;FLANKING_PAIRS=1")
    assert "PARID=4a" in got["3a"][4] and "EVENT=TRL3-4" in got["3a"][4] and "PARID=3b" in got["4b"][4]
    assert got["5"][2:4] == ("ATTT", "A") and got["6"][3] == "<DEL>" and "SVLEN=-2003" in got["6"][4]
    assert got["7-8"][:4] == ("5", 90, "T", "<INS>") and "BKPTID=k8,k9" in got["7-8"][4] and "SPANNING_READS=6" in got["7-8"][4]
