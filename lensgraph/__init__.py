"""Embedding, lens, graph and indexing analytics on Spark DataFrames."""
