"""Document reconstruction and corpus auditing on Spark DataFrames."""
