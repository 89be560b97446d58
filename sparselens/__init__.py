"""Sparse-feature activation analytics on Spark DataFrames."""
