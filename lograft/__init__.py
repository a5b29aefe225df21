"""Logs and text corpora as Spark DataFrames."""
