"""Order-book factor analytics on Spark DataFrames."""
