"""lumiquarry: media-library and training-data analytics on Spark DataFrames."""
