"""Catalogue analytics on Spark DataFrames."""
