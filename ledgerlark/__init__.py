"""Portfolio analytics on Spark DataFrames."""
