"""Prescription-claims analytics on Spark DataFrames and Structured Streaming."""
