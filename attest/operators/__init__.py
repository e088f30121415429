"""Relational operators over sampled streams, trees, boxes, facts and scores. DataFrames in, DataFrames out."""
