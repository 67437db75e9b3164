"""tallyframe: evaluation analytics on Spark DataFrames."""
