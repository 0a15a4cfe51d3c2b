"""helixloom: long-read variant analytics on Spark DataFrames."""
