"""millrace: ranked retrieval and corpus analytics on Spark DataFrames."""
