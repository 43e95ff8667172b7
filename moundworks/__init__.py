"""Pitch-level analytics on Spark DataFrames."""
