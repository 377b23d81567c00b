"""Set-at-a-time knowledge-base analytics on Spark DataFrames."""
