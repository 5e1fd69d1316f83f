"""Hybrid retrieval and memory engine on Spark DataFrames."""
