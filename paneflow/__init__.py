"""Panel and spatial analytics on Spark DataFrames."""
