"""Readers and writers of hypergraph files, and generators."""
