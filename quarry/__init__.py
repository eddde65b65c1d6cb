"""Hybrid retrieval over collections of chunks, planned as Spark DataFrames."""
