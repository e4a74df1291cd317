"""frameloom: adaptive-sampling analytics on Spark DataFrames."""
