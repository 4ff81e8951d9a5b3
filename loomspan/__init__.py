"""Interval, summary and family analytics on Spark DataFrames."""
