"""Evaluation and analytics on Spark DataFrames."""
