"""Passage-link analytics and corpus processing on Spark DataFrames."""
