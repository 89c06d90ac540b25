"""newsloom: content-intelligence analytics on Spark DataFrames."""
