"""linkforge: record linkage and training-data operators on Spark DataFrames."""
