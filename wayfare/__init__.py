"""Distance-based node importance and corpus processing on Spark DataFrames."""
