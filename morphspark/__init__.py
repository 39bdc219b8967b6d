"""Declarative model transformation and object-collection queries on Spark DataFrames."""
