"""cairn: versioned, columnar tables and training-data operators as lazy Spark DataFrames."""
