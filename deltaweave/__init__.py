"""Incremental graph analytics on Spark DataFrames."""
