"""Operators: each takes DataFrames and arguments and returns a DataFrame plan."""
