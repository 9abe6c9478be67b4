"""wakeline: evidence-episode analytics on Spark DataFrames."""
