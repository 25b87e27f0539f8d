"""Citation-context analytics on Spark DataFrames."""
