"""Point-in-time market-data analytics on Spark: lazy functions from DataFrames to DataFrames."""
