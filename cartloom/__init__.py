"""Retail basket analytics, product retrieval and promotion planning on Spark DataFrames."""
