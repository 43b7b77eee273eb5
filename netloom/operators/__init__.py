"""Operators on hypergraphs: transforms, statistics, traversal, partitioning, placement, scores, similarity, results."""
