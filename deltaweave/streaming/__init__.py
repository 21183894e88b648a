"""Streams of edge changes."""
