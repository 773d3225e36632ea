"""Renderers and writers of VCF, BEDPE, BED, FASTA and plain tables."""
