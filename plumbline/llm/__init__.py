"""Operators for training-data pipelines over Spark DataFrames (see README.md in this folder)."""
