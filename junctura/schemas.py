"""Schemas of the tables that operators exchange, as DDL. Coordinates are 1-based and inclusive."""

BLOCKS = "array<struct<ts: bigint, te: bigint, qs: bigint, qe: bigint>>"
CIGAR = "array<struct<op: string, len: int>>"

ALIGNMENTS = (
    "seq_no bigint, query string, flag int, target string, pos bigint, mapq int, cigar " + CIGAR + ", mate_target string, mate_pos bigint, tlen int, seq string, nm int"
)
SEGMENTS = "seg_id bigint, query string, query_len int, target string, strand string, qstart bigint, qend bigint, tstart bigint, tend bigint, blocks " + BLOCKS + ", is_primary boolean, nm int, mapq int"
SEQUENCES = "name string, seq string"
TRANSCRIPTS = "tid string, gene string, chrom string, strand string, coding boolean, cds_start bigint, cds_end bigint, exons array<struct<start: bigint, end: bigint>>"
ADJACENCIES = (
    "adj_id bigint, rearrangement string, chrom1 string, break1 bigint, orient1 string, chrom2 string, break2 bigint, orient2 string, size bigint, align_type string, novel_seq string, dubious boolean"
)
VARIANTS = "variant_id string, event string, chrom string, pos bigint, adj_ids array<bigint>"
