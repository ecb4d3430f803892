"""Operators of a training-data pipeline: formatting, filtering, duplicates, mixing, sharding, archives."""
