"""callweave: whole-program graph analytics on Spark DataFrames."""
