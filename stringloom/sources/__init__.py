"""Readers and writers of text formats: record files, FASTA, node dumps, Newick, matrices."""
