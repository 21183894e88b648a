"""Readers, writers and generators of graphs, changes and results."""
