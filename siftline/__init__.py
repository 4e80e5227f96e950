"""siftline: search, narrowing and ranking of document collections, and data preparation, on Spark DataFrames."""
