"""Analytics over bill-of-materials documents on Spark DataFrames."""
