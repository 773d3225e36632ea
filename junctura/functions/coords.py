"""Chromosome order and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chrom_key(chrom: Column) -> Column:
    """A sort key: numbers before names, each in their order; a leading ``chr`` does not matter."""
    bare = F.regexp_replace(chrom, "^(?i)chr", "")
    number = bare.try_cast("int")
    return F.struct(number.isNull().alias("named"), F.coalesce(number, F.lit(0)).alias("number"), bare.alias("name"))


def place_key(chrom: Column, pos: Column) -> Column:
    return F.struct(chrom_key(chrom).alias("chrom"), pos.alias("pos"))


def is_alternative(chrom: Column) -> Column:
    """Names of haplotypes and unplaced pieces hold an underscore."""
    return F.contains(chrom, F.lit("_"))


def is_canonical(chrom: Column) -> Column:
    """A number, X or Y after a leading ``chrom`` or ``chr``."""
    return F.regexp_replace(chrom, "^(?i)[chrom]+", "").rlike("^(?:[0-9]+|[XY])$")
