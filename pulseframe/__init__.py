"""Batch jobs for wearable-signal event data, and operators for training-data pipelines, on Spark DataFrames."""
