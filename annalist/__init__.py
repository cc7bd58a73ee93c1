"""A temporal fact-graph engine on Spark DataFrames."""
