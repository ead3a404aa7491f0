"""Document comparison and data processing on Spark DataFrames."""
