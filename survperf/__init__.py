"""Surveillance-performance analytics on Spark DataFrames."""
