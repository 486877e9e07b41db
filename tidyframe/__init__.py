"""Profiling and cleaning of large tables with Spark DataFrames."""
