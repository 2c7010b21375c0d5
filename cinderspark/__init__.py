"""Point-in-space-and-time feature engine on Spark DataFrames."""
