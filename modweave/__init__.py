"""Module-graph analytics on Spark DataFrames."""
