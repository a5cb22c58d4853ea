"""Interval analytics for insertions in long-read alignments, on Spark DataFrames."""
