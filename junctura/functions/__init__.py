"""Column functions over sequences, alignments, coordinates and transcripts."""
