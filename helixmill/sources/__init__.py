"""Readers and writers: FASTQ, reads derived from text, sequence files."""
