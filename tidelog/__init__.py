"""Change-log analytics on Spark DataFrames."""
