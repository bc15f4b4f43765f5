"""Irregular reductions, graph and particle analytics on Spark DataFrames."""
