"""Base modifications of aligned reads as Spark DataFrames."""
