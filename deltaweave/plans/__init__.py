"""Lineage, derived graphs and other plan building blocks."""
