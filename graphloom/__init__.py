"""Property-graph pattern analytics on Spark DataFrames."""
