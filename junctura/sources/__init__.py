"""Readers of alignment, sequence, annotation, variant and interval files."""
