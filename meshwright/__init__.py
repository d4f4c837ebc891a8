"""Spatial-network analytics on Spark DataFrames."""
