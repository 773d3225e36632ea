"""Readers of text formats, each a Spark read and a projection. Coordinates come out 1-based and inclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cigar import parse_cigar


def _table(spark: SparkSession, path: str, schema: str, comment: str | None = "#") -> DataFrame:
    reader = spark.read.option("sep", "\t").option("quote", "").schema(schema)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text. seq_no follows the order of files and lines."""
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("@"))).withColumn("seq_no", F.monotonically_increasing_id())
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    nm = F.nullif(F.regexp_extract("value", r"\tNM:i:([0-9]+)", 1), F.lit("")).cast("int")
    star = lambda c: F.when(c != "*", c)
    return rows.select(
        "seq_no", at(0).alias("query"), at(1).cast("int").alias("flag"), star(at(2)).alias("target"), at(3).cast("bigint").alias("pos"), at(4).cast("int").alias("mapq"), parse_cigar(at(5)).alias("cigar"),
        star(F.when(at(6) == "=", at(2)).otherwise(at(6))).alias("mate_target"), at(7).cast("bigint").alias("mate_pos"), at(8).cast("int").alias("tlen"), star(at(9)).alias("seq"), nm.alias("nm"),
    )


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, seq) of FASTA records; lines of a sequence are joined. A record is one row, so genomes are read in chunks with
    ``chunked``."""
    rows = spark.read.option("lineSep", "\n>").text(path).where("length(trim(value)) > 0")
    rows = rows.select(F.regexp_replace("value", "^>", "").alias("v")).select(F.split("v", "\n", 2).alias("p"))
    head = F.get("p", F.lit(0))
    return rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_extract(head, r"^\S*\s*(.*)$", 1)).alias("description"), F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"\s", "").alias("seq"))


def chunked(sequences: DataFrame, chunk: int) -> DataFrame:
    """(name, chunk_no, seq) in pieces of ``chunk`` bases."""
    n = F.floor((F.length("seq") - 1) / chunk)
    rows = sequences.where("length(seq) > 0").select("name", "seq", F.explode(F.sequence(F.lit(0), n)).alias("chunk_no"))
    return rows.select("name", "chunk_no", F.substr("seq", (F.col("chunk_no") * chunk + 1).cast("int"), F.lit(chunk)).alias("seq"))


def fetch(spans: DataFrame, genome: DataFrame, chunk: int, key: list[str]) -> DataFrame:
    """Adds seq, the bases from start to end (columns chrom, start, end), to spans: each joins the chunks that it touches."""
    at = lambda c: F.floor((F.col(c) - 1) / chunk)
    rows = spans.select(*key, "chrom", "start", "end", F.explode(F.sequence(at("start"), at("end"))).alias("chunk_no")).join(genome.withColumnRenamed("name", "chrom"), ["chrom", "chunk_no"])
    base = F.col("chunk_no") * chunk
    first, last = F.greatest(F.col("start"), base + 1), F.least(F.col("end"), base + chunk)
    parts = rows.select(*key, F.struct(first.alias("at"), F.substr("seq", (first - base).cast("int"), (last - first + 1).cast("int")).alias("piece")).alias("p"))
    found = parts.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["piece"]), "").alias("seq"))
    return spans.join(found, key, "left")


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """(row, feature, chrom, start, end, strand, gene, tid) of GTF lines; gene is gene_name where there is one, else gene_id."""
    rows = _table(spark, path, "chrom string, source string, feature string, start bigint, end bigint, score string, strand string, frame string, attributes string")
    value = lambda k: F.nullif(F.regexp_extract("attributes", rf'\b{k} "([^"]*)"', 1), F.lit(""))
    return rows.select(F.monotonically_increasing_id().alias("row"), "feature", "chrom", "start", "end", "strand", F.coalesce(value("gene_name"), value("gene_id")).alias("gene"), value("transcript_id").alias("tid"))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """VCF records with their INFO as a map; flags have a null value."""
    rows = _table(spark, path, "chrom string, pos bigint, id string, ref string, alt string, qual string, filter string, info string, format string, sample string")
    return rows.withColumn("info", F.expr("str_to_map(info, ';', '=')"))


def calls(records: DataFrame) -> DataFrame:
    """(vchrom, vpos, ref, alt, ad, dp) of VCF records of one sample: the reads with the first alternative allele and all; null where not given."""
    of = F.map_from_arrays(F.split("format", ":"), F.split("sample", ":"))
    value = lambda k: F.try_element_at(of, F.lit(k))
    return records.select(F.col("chrom").alias("vchrom"), F.col("pos").alias("vpos"), "ref", "alt", F.try_element_at(F.split(value("AD"), ","), F.lit(2)).alias("ad"), value("DP").alias("dp"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    rows = _table(spark, path, "chrom string, start bigint, end bigint, name string")
    return rows.where(~F.col("chrom").rlike("^(?:track|browser)")).withColumn("start", F.col("start") + 1)


def cytobands(spark: SparkSession, path: str, stain: str = "acen") -> DataFrame:
    rows = _table(spark, path, "chrom string, start bigint, end bigint, name string, stain string")
    return rows.where(F.col("stain") == stain).withColumn("start", F.col("start") + 1)


def bedpe(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """BEDPE rows with these columns, all text; a header without # is left out."""
    return _table(spark, path, ", ".join(f"`{c}` string" for c in columns)).where(F.col(f"`{columns[0]}`") != columns[0])


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(contig, span1, span2, align_type), spans in order."""
    rows = _table(spark, path, "contig string, a bigint, b bigint, align_type string")
    return rows.select("contig", F.least("a", "b").alias("span1"), F.greatest("a", "b").alias("span2"), "align_type")


def support(spark: SparkSession, path: str) -> DataFrame:
    """(contig, span1, span2, spanning, flanking)."""
    rows = _table(spark, path, "contig string, span string, spanning int, flanking int")
    part = lambda i: F.get(F.split("span", "-"), F.lit(i)).cast("bigint")
    return rows.select("contig", part(0).alias("span1"), part(1).alias("span2"), "spanning", "flanking")


def blast(spark: SparkSession, path: str, most_clipped: int = 0) -> DataFrame:
    """Tabular hits that leave at most ``most_clipped`` of the query's bases out; needs a 13th column, the query's length."""
    rows = _table(spark, path, "query string, target string, identity double, length int, mismatches int, gaps int, qstart bigint, qend bigint, tstart bigint, tend bigint, evalue double, score double, query_len bigint")
    return rows.where(F.abs(F.col("qend") - F.col("qstart")) + 1 >= F.col("query_len") - most_clipped)


def names(spark: SparkSession, path: str) -> DataFrame:
    """(name), one for each line that is not empty."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct()
