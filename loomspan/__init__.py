"""Tensor analytics and compression on Spark DataFrames."""
