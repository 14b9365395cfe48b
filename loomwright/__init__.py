"""Data-readiness analytics on Spark DataFrames."""
