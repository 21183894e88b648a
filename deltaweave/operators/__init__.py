"""Operators over graphs and vertex state."""
