"""Document retrieval and extractive question answering on Spark DataFrames."""
