"""Lodestone: an evidence engine over Spark DataFrames."""
