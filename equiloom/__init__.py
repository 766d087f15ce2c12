"""Equity analytics on Spark: every operator takes and returns lazy DataFrames."""
