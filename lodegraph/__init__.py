"""Code-evolution graph analytics on Spark DataFrames."""
