"""Analytics over source-code corpora and the logs around them, on Spark DataFrames."""
