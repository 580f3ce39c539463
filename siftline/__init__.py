"""Posts to tables to models, on Spark DataFrames."""
