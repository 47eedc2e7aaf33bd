"""Analytics over data-pipeline metadata with Spark DataFrames."""
