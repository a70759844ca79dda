"""Speech-evaluation analytics and corpus preparation on Spark DataFrames."""
