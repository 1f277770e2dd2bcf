"""Operators of a training-data pipeline: one module per operator, queries.py binds them to the tables."""
