"""Building-sensor analytics on Spark DataFrames."""
