"""Behavioural telemetry analytics on Spark DataFrames."""
