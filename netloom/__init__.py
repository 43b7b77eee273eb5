"""Hypergraph analytics on DataFrames: statistics, similarity, partitioning, placement, scoring and results."""
