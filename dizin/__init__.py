"""dizin: catalogue integration on Spark DataFrames."""
