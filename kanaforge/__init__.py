"""Spark jobs that annotate text corpora with phonetic readings."""
