"""Rough-path features, kernels and streams over Spark DataFrames."""
