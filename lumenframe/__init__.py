"""lumenframe: retrieval, colour and evaluation operators as Spark DataFrames."""
