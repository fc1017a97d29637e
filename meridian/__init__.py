"""Catalog search, dependency analytics and corpus preparation on Spark DataFrames."""
