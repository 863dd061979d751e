"""Deduplication and similarity analytics on Spark DataFrames."""
