"""Analytics over transit networks, expressed in Spark DataFrames."""
