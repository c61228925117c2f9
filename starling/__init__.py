"""Clustering analytics on Spark DataFrames."""
