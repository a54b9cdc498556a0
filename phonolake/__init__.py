"""Speech-corpus and pronunciation analytics on Spark DataFrames."""
