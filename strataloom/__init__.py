"""Topological data analysis over Spark DataFrames."""
