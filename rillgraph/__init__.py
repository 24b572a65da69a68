"""rillgraph: cross-service flow analytics on Spark DataFrames."""
