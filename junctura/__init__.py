"""Post-assembly variant discovery on Spark: alignments of assembled contigs in, breakpoints, variants, fusions and splice events out."""
