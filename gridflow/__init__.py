"""Gridded-observation analytics on Spark DataFrames."""
